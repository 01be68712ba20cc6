"""Accuracy and inventory metrics.

Per-series sums are grouped by (keys, sid); pooled figures are ratios of sums (G13), never
means of ratios. Cross-series medians use the skew-safe ``exact_percentiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import Costs
from shelfcast.functions.columns import newsvendor_cost, served
from shelfcast.operators.features import seasonal_residuals
from shelfcast.operators.quantiles import exact_percentiles


def seasonal_scale(panel: DataFrame, cuts, m: int) -> DataFrame:
    """A8 per rolling origin: mean |y[t] − y[t−m]| over the history before the cut.

    Origins are columns of one grouped aggregate (conditional averages), then unpivoted.
    ``cuts`` is a list of (fold, cut).
    """
    res = seasonal_residuals(panel, m)
    g = res.groupBy("sid").agg(*[F.avg(F.when(F.col("wk") < c, F.abs("residual"))).alias(f"_s{f}")
                                 for f, c in cuts])
    rows = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut"), F.col(f"_s{f}").alias("scale"))
                     for f, c in cuts])
    return g.select("sid", F.inline(rows)).select("fold", "cut", "sid", "scale")


def score_series(forecasts: DataFrame, panel: DataFrame, scale: DataFrame, keys: list[str],
                 costs: Costs) -> DataFrame:
    """R11 + A7, A9, A10, A13: per (keys, sid): cost, demand, served, mae, scale, mase.

    The order is the critical-ratio quantile; the point forecast for MASE is the median.
    """
    truth = panel.select("sid", "wk", "y")
    j = forecasts.join(truth, ["sid", "wk"])
    per = (j.groupBy(*keys, "sid")
            .agg(F.sum(newsvendor_cost("q_cr", "y", costs.holding, costs.stockout)).alias("cost"),
                 F.sum("y").alias("demand"),
                 F.sum(served("q_cr", "y")).alias("served"),
                 F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae")))
    per = per.join(scale, ["fold", "cut", "sid"], "left")
    return per.withColumn("mase", F.try_divide(F.col("mae"), F.col("scale")))


def pooled(keys: list[str]):
    """Pooled cost/unit and fill rate expressions for a groupBy."""
    return [(F.sum("cost") / F.sum("demand")).alias("cost_per_unit"),
            (F.sum("served") / F.sum("demand")).alias("fill_rate")]


def summarize(per_series: DataFrame, keys: list[str], unscaled: bool = False) -> DataFrame:
    """Mean and median MASE, pooled cost/unit, fill rate and series count per cell.

    A series whose scale is zero or unknown has no MASE and is left out of its mean and median; ``unscaled`` adds their
    number as ``n_unscaled`` (G10)."""
    main = per_series.groupBy(*keys).agg(F.avg("mase").alias("MASE"), *pooled(keys),
                                         F.count("sid").alias("n_series"),
                                         *([F.count(F.when(F.col("mase").isNull(), 1)).alias("n_unscaled")] if unscaled else []))
    med = exact_percentiles(per_series, keys, "mase", [0.5], ["MASE_median"]).drop("n")
    return main.join(med, keys, "left")


def newsvendor_totals(orders: DataFrame, costs: Costs, order: str = "order", demand: str = "demand") -> DataFrame:
    """A10–A12 over any (order, demand) rows: total cost, cost per unit, fill rate."""
    c = newsvendor_cost(order, demand, costs.holding, costs.stockout)
    return orders.agg(F.sum(c).alias("total_cost"),
                      (F.sum(c) / F.sum(demand)).alias("cost_per_unit"),
                      (F.sum(served(order, demand)) / F.sum(demand)).alias("fill_rate"))
