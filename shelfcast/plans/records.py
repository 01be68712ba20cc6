"""Cell records (K4, S6, T5, T8): what one (dataset, model, regime) run leaves behind.

A record is one nested row: the parameters chosen, the wall time, the validation cost of every parameter set tried and
the test summary. The per-series scores grow with the data and lie beside the records as part files of their cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.metrics import summarize
from shelfcast.plans.experiment import (DEFAULT_WINDOW, STATISTICAL, TUNED, UNTUNED, Study, best_params, tuning_trials)
from shelfcast.plans.forecasters import PARAM_COLUMNS
from shelfcast.sources.sinks import write_cells

CELL = ["dataset", "model", "regime"]
MODELS = ("seasonal_naive", "moving_average", "quantile_forest")
#: model -> parameters of its untuned cell
DEFAULTS = {"moving_average": {"window": DEFAULT_WINDOW}, "quantile_forest": {"depth": 8, "trees": 20}}
SUMMARY = ("MASE", "MASE_median", "cost_per_unit", "fill_rate", "n_series", "n_unscaled")
TUNING = "array<struct<grid_idx:int,params:string,cost_per_unit:double>>"
RECORD = ("dataset string, model string, regime string, params string, seconds double, "
          f"tuning {TUNING}, summary struct<MASE:double,MASE_median:double,cost_per_unit:double,fill_rate:double,n_series:bigint,n_unscaled:bigint>")


def _params(model: str):
    """The parameters as JSON text ({} for a model without any)."""
    cols = PARAM_COLUMNS[model]
    return F.to_json(F.struct(*cols)) if cols else F.lit("{}")


def run_cells_of(study: Study, model: str) -> tuple[DataFrame, DataFrame]:
    """(records, per-series test scores) of a model's cells in a study.

    A model with parameters has an untuned cell (``DEFAULTS``) and one with the parameters that cost least on the validation
    folds (T1-T3); one without has a single cell. All trials are fitted once for both."""
    per = study.per_series(model)
    cols, test = PARAM_COLUMNS[model], per.filter(F.col("fold") == 0)
    none = F.lit(None).cast(TUNING)
    if not cols:
        runs = [(STATISTICAL, test, none)]
    else:
        trials = tuning_trials(study, model, per)
        tried = trials.agg(F.array_sort(F.collect_list(F.struct("grid_idx", _params(model).alias("params"), "cost_per_unit"))))
        default = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in DEFAULTS[model].items()])
        runs = [(UNTUNED, test.filter(default), none),
                (TUNED, test.join(F.broadcast(best_params(trials, model).select(*cols)), cols), tried.scalar())]
    records, scores = [], []
    for regime, rows, tuning in runs:
        named = rows.select(F.lit(study.name).alias("dataset"), F.lit(model).alias("model"), F.lit(regime).alias("regime"),
                            _params(model).alias("params"), "sid", "cost", "demand", "served", "mase")
        summary = summarize(named, [*CELL, "params"], unscaled=True)
        records.append(summary.select(*CELL, "params", F.lit(study.seconds[model]).alias("seconds"), tuning.alias("tuning"),
                                      F.struct(*SUMMARY).alias("summary")))
        scores.append(named.drop("params"))
    return reduce(DataFrame.unionByName, records), reduce(DataFrame.unionByName, scores)


def fitted_cells(study: Study, models=MODELS) -> tuple[DataFrame, DataFrame]:
    """(records, per-series scores) of all cells of ``models``."""
    outs = [run_cells_of(study, m) for m in models]
    return tuple(reduce(DataFrame.unionByName, part) for part in zip(*outs))


def write_records(records: DataFrame, per_series: DataFrame, path: str) -> None:
    """Both tables by cell; a cell that is run again replaces its own rows and no other's. The scores come first, so a record
    that is there has its scores."""
    write_cells(per_series, f"{path}/per_series")
    write_cells(records, f"{path}/records")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, per-series scores) as they were written."""
    records = spark.read.schema(RECORD).parquet(f"{path}/records")
    scores = "dataset string, model string, regime string, sid string, cost double, demand double, served double, mase double"
    return records, spark.read.schema(scores).parquet(f"{path}/per_series")


def cell_table(records: DataFrame) -> DataFrame:
    """The records as flat rows (cell, params and the test summary), as the report's tables take them."""
    return records.select(*CELL, "params", "summary.*")


def tuning_report(records: DataFrame) -> DataFrame:
    """Parameter sets tried, best and worst validation cost and minutes of every tuned cell."""
    cost = F.col("tuning.cost_per_unit")
    return records.filter(F.size("tuning") > 0).select(
        *CELL, F.size("tuning").alias("configs"), F.array_min(cost).alias("best"), F.array_max(cost).alias("worst"),
        (F.col("seconds") / 60).alias("minutes"))
