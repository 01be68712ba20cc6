"""Rolling-origin evaluation (T1–T6): trials are rows, not loop iterations.

One plan forecasts every (fold, params) trial; validation pools folds 1..F (T2); the winner
is the lowest validation cost, first in grid order on ties (T3, G12); the test window is
scored from the same plan (fold 0) and filtered to the winner (T4).
"""

from __future__ import annotations

import time
import traceback
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import TESTDATA_SPEC, Costs, PanelSpec
from shelfcast.functions.columns import order_levels
from shelfcast.operators import panel as P
from shelfcast.operators.metrics import pooled, score_series, seasonal_scale, summarize
from shelfcast.session import materialize
from shelfcast.plans.forecasters import GRIDS, PARAM_COLUMNS, get_forecaster
from shelfcast.sources.testdata import TableSource, sales_view

TUNED, UNTUNED, STATISTICAL = "fine_tune", "zero_shot", "statistical"
DEFAULT_WINDOW = 4


@dataclass
class Study:
    """One dataset: a sales view, its calendar and costs, and the panels derived from it.

    Without ``spec`` the calendar spans the sales of the table: the weekly sums are written once and give the
    calendar and the panels, so the sales are read one time."""

    spark: SparkSession
    root: str
    level: str = "region"
    spec: PanelSpec | None = None
    costs: Costs | None = None
    _memo: dict = field(default_factory=dict)
    seconds: dict = field(default_factory=dict)  # model -> wall time of its trials (T5)

    def __post_init__(self):
        if self.spec is None:
            self.sums, self.spec = P.weekly_sums_and_calendar(self.sales, TESTDATA_SPEC)
        else:
            self.sums = P.weekly_sums(self.sales, self.spec)

    @property
    def name(self) -> str:
        return f"brand_{self.level}"

    @property
    def cost(self) -> Costs:
        return self.costs or self.spec.costs

    @property
    def levels(self):
        return order_levels(self.cost)

    @cached_property
    def src(self) -> TableSource:
        return TableSource(self.spark, self.root)

    @cached_property
    def sales(self) -> DataFrame:
        return sales_view(self.src, self.level)

    @cached_property
    def weekly(self) -> DataFrame:
        return P.densify_weeks(self.sums, self.spec)

    @cached_property
    def listed(self) -> DataFrame:
        return P.listed_panel(self.weekly)

    @cached_property
    def eligible(self) -> DataFrame:
        return P.eligible_series(self.weekly, self.spec)

    @cached_property
    def panel(self) -> DataFrame:
        """Model panel: listed values of the eligible series, materialised once (every model,
        fold and metric reads it; it is series × weeks, far smaller than the sales)."""
        return materialize(P.restrict(self.listed, self.eligible))

    def cuts(self, include_test: bool = True) -> list[tuple[int, int]]:
        """Rolling origins (fold, cut): folds 1..F, and fold 0 = the test window."""
        out = [(f, self.spec.fold_cut(f)) for f in range(1, self.spec.folds + 1)]
        return out + [(0, self.spec.test_cut)] if include_test else out

    @cached_property
    def scale(self) -> DataFrame:
        return seasonal_scale(self.panel, self.cuts(), self.spec.seasonality)

    def forecasts(self, model: str, **params) -> DataFrame:
        fn = get_forecaster(model)
        return fn(self.panel, self.cuts(), self.spec, self.levels, **params)

    def per_series(self, model: str, **params) -> DataFrame:
        """Per (fold, cut, params, sid) scores of every trial and the test window."""
        memo_key = (model, tuple(sorted(params.items())))
        if memo_key not in self._memo:
            keys = ["fold", "cut", *PARAM_COLUMNS[model]]
            panel = self.panel  # its time is no model's
            # Small (origins × params × series) and read by tuning, selection and test scoring.
            self._memo[memo_key], self.seconds[model] = timed(lambda: materialize(
                score_series(self.forecasts(model, **params), panel, self.scale, keys, self.cost)))
        return self._memo[memo_key]


# M9: dataset name → loader returning the study (sales view, panels, calendar and costs).
DATASETS = {
    "brand_region": lambda spark, root: Study(spark, root, "region"),
    "brand_nation": lambda spark, root: Study(spark, root, "nation"),
}


def load_dataset(name: str, spark: SparkSession, root: str) -> Study:
    return DATASETS[name](spark, root)


def grid_frame(spark: SparkSession, model: str) -> DataFrame:
    """The parameter grid as rows with its grid index (for first-in-grid tie breaks)."""
    cols = PARAM_COLUMNS[model]
    rows = [(i, *[g[c] for c in cols]) for i, g in enumerate(GRIDS[model])]
    schema = "grid_idx int" + "".join(f", {c} int" for c in cols)
    return spark.createDataFrame(rows, schema)


def tuning_trials(study: Study, model: str, per_series: DataFrame | None = None) -> DataFrame:
    """T1 + T2: validation cost/unit per parameter set, pooled over all validation folds."""
    per = per_series if per_series is not None else study.per_series(model)
    cols = PARAM_COLUMNS[model]
    val = per.filter(F.col("fold") >= 1).groupBy(*cols).agg(*pooled(cols)[:1]) if cols else \
        per.filter(F.col("fold") >= 1).agg(*pooled(cols)[:1])
    grid = grid_frame(study.spark, model)
    if not cols:  # a parameter-free model has a one-entry grid
        return val.select(F.lit(0).alias("grid_idx"), "cost_per_unit")
    return grid.join(val, cols).select("grid_idx", *cols, "cost_per_unit")


def best_params(trials: DataFrame, model: str) -> DataFrame:
    """Lowest validation cost, first in grid order on ties."""
    cols = PARAM_COLUMNS[model]
    order = F.struct("cost_per_unit", "grid_idx")
    picks = [F.min_by(F.col(c), order).alias(c) for c in cols]
    return trials.agg(*picks, F.min("cost_per_unit").alias("cost_per_unit"))


def holdout_summary(study: Study, model: str, per_series: DataFrame | None = None) -> DataFrame:
    """Test-window summary of every grid configuration (fold 0)."""
    per = per_series if per_series is not None else study.per_series(model)
    cols = PARAM_COLUMNS[model]
    return summarize(per.filter(F.col("fold") == 0), cols) if cols else \
        summarize(per.filter(F.col("fold") == 0).withColumn("_one", F.lit(1)), ["_one"]).drop("_one")


def cells(study: Study) -> tuple[DataFrame, DataFrame]:
    """Cells of the study and their per-series test scores.

    Cells: seasonal_naive/statistical; moving_average/zero_shot (default window, untuned);
    moving_average/fine_tune (window chosen on validation). Returns (cells, per_series).
    """
    sn = study.per_series("seasonal_naive").filter(F.col("fold") == 0)
    ma_all = study.per_series("moving_average")
    best = best_params(tuning_trials(study, "moving_average", ma_all), "moving_average")
    ma_test = ma_all.filter(F.col("fold") == 0)
    tuned = ma_test.join(F.broadcast(best.select("window")), "window")
    zero = ma_test.filter(F.col("window") == DEFAULT_WINDOW)
    cols = ["sid", "cost", "demand", "served", "mase", "window"]
    per = (sn.withColumn("window", F.lit(None).cast("int")).select(*cols)
             .withColumn("model", F.lit("seasonal_naive")).withColumn("regime", F.lit(STATISTICAL))
           .unionByName(zero.select(*cols).withColumn("model", F.lit("moving_average"))
                        .withColumn("regime", F.lit(UNTUNED)))
           .unionByName(tuned.select(*cols).withColumn("model", F.lit("moving_average"))
                        .withColumn("regime", F.lit(TUNED)))
           .withColumn("dataset", F.lit(study.name)))
    per = materialize(per)
    summary = summarize(per, ["dataset", "model", "regime"])
    params = per.groupBy("dataset", "model", "regime").agg(F.max("window").alias("window"))
    return summary.join(params, ["dataset", "model", "regime"]), per


def timed(fn, *args, **kwargs):
    """T5: wall-clock seconds of an action on the driver."""
    start = time.perf_counter()
    out = fn(*args, **kwargs)
    return out, time.perf_counter() - start


def run_cells(spark: SparkSession, jobs: list[tuple[str, callable]], failures_path: str | None = None):
    """Run each cell job; a failing cell is reported and skipped, never fatal.

    ``jobs`` is a list of (label, zero-arg callable). Returns (results, failures DataFrame).
    """
    results, failed = [], []
    for label, job in jobs:
        try:
            out, secs = timed(job)
            results.append((label, out, secs))
        except Exception as exc:  # noqa: BLE001 — report and continue, like the benchmark runner
            failed.append((label, type(exc).__name__, str(exc)[:2000], traceback.format_exc()[-4000:]))
    fdf = spark.createDataFrame(failed, "cell string, error string, message string, trace string")
    if failures_path and failed:
        fdf.write.mode("append").parquet(failures_path)
    return results, fdf
