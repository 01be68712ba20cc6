"""Report tables over scored cells.

The cell table has one row per (dataset, model, regime): its size is set by the experiment
design, not by the data, so the per-dataset windows below are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import MAKE_MODELS
from shelfcast.functions.columns import cell_label, pvalue_text
from shelfcast.operators.bootstrap import significance


def leaderboard(cells: DataFrame) -> DataFrame:
    """A16 + T7: place per dataset by test cost per unit (ties: model, regime)."""
    w = Window.partitionBy("dataset").orderBy("cost_per_unit", "model", "regime")
    return cells.select("dataset", F.row_number().over(w).alias("place"), "model", "regime", "cost_per_unit")


def tuning_summary(trials: DataFrame) -> DataFrame:
    """Configs tried, best and worst validation cost per cell (minutes need timings)."""
    return trials.groupBy("dataset", "model", "regime").agg(
        F.count(F.lit(1)).alias("configs"), F.min("cost_per_unit").alias("best"),
        F.max("cost_per_unit").alias("worst"))


def best_built(cells: DataFrame, make_models=MAKE_MODELS) -> DataFrame:
    """Cheapest cell per dataset among the models built in-house (none → no row)."""
    built = cells.filter(F.col("model").isin(list(make_models)))
    order = F.struct("cost_per_unit", "model", "regime")
    return built.groupBy("dataset").agg(F.min_by("model", order).alias("model"),
                                        F.min_by("regime", order).alias("regime"),
                                        F.min("cost_per_unit").alias("cost_per_unit"))


def planned_pairs(cells: DataFrame, buy_models: list[str], zero: str, tuned: str,
                  make_models=MAKE_MODELS) -> DataFrame:
    """T10 pairs: (zero − best built), (tuned − zero), (tuned − best built) per bought model;
    pairs with a missing side are skipped (inner joins)."""
    best = best_built(cells, make_models).select("dataset", F.col("model").alias("m"), F.col("regime").alias("r"))
    c = cells.select("dataset", "model", "regime")
    z = c.filter(F.col("model").isin(buy_models) & (F.col("regime") == zero))
    t = c.filter(F.col("model").isin(buy_models) & (F.col("regime") == tuned))

    def pair(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.join(b, on).select("dataset", "model_a", "regime_a", "model_b", "regime_b")

    za = z.select("dataset", F.col("model").alias("model_a"), F.col("regime").alias("regime_a"))
    ta = t.select("dataset", F.col("model").alias("model_a"), F.col("regime").alias("regime_a"))
    bb = best.select("dataset", F.col("m").alias("model_b"), F.col("r").alias("regime_b"))
    zb = z.select("dataset", F.col("model").alias("model_b"), F.col("regime").alias("regime_b"),
                  F.col("model").alias("model_a"))
    return (pair(za, bb, ["dataset"])
            .unionByName(pair(ta, zb, ["dataset", "model_a"]))
            .unionByName(pair(ta, bb, ["dataset"])))


def planned_contrasts(cells: DataFrame, per_series: DataFrame, buy_models: list[str], zero: str, tuned: str,
                      resamples: int, make_models=MAKE_MODELS) -> DataFrame:
    """T10 + F24: labelled contrasts on cost per unit with bootstrap p text.

    The observed a/b come from the bootstrap's own observed replicate, which pools the same
    per-series rows as the cell summary.
    """
    pairs = planned_pairs(cells, buy_models, zero, tuned, make_models)
    test = significance(per_series, resamples, pairs=pairs, metrics=("cost_per_unit",))
    # paired_tests orders nothing: a pair is (A, B) exactly as planned.
    return test.select("dataset", cell_label("model_a", "regime_a").alias("label_a"),
                       cell_label("model_b", "regime_b").alias("label_b"),
                       F.col("a").alias("cost_a"), F.col("b").alias("cost_b"), "diff",
                       pvalue_text("p_value").alias("p"))


def rank_disagreement(cells: DataFrame) -> DataFrame:
    """Cells whose rank by mean MASE differs from their rank by cost per unit."""
    by_mase = Window.partitionBy("dataset").orderBy("MASE")
    by_cost = Window.partitionBy("dataset").orderBy("cost_per_unit")
    r = cells.select("dataset", "model", "regime", F.rank().over(by_mase).alias("mase_rank"),
                     F.rank().over(by_cost).alias("cost_rank"))
    return r.filter(F.col("mase_rank") != F.col("cost_rank"))


def grid_edge(best: DataFrame, grid_values: list, param: str) -> DataFrame:
    """Is the winning value the smallest or largest of its grid (a driver-side parameter list)?"""
    lo, hi = min(grid_values), max(grid_values)
    return best.select("*", ((F.col(param) == F.lit(lo)) | (F.col(param) == F.lit(hi))).alias("is_edge"))
