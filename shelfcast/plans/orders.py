"""Next-month order plan.

sales → dense daily panel (zero before a first sale too) → 28-day moving average with
per-step residual quantiles at the critical ratio → whole units (half-to-even, per day) →
per (store, item) totals → non-zero plan. The daily series is bounded by the calendar
(~2,500 days), so each (series, step) residual group is bounded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import COST_SETS, DAILY_HORIZON
from shelfcast.functions.columns import half_even, order_levels
from shelfcast.operators.features import computed, full_means
from shelfcast.operators.panel import daily_series, daily_series_by
from shelfcast.operators.quantiles import array_percentile

KEYS = ["store_id", "item_id"]


def daily_order_forecast(sales: DataFrame, window: int = DAILY_HORIZON, horizon: int = DAILY_HORIZON,
                         level: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(store_id, item_id, step, forecasted_date, order) — unrounded order quantity per day. With ``by`` (a company) each
    group has its own calendar, and its columns come first.

    One row per series holds its days as an array; means, each step's residuals and their percentile are
    computed within the row, so nothing but the daily sums is ever shuffled."""
    level = order_levels(COST_SETS["m5"])[1] if level is None else level
    keys = [*(by or []), *KEYS]
    base = computed(daily_series_by(sales, by) if by else daily_series(sales), v=F.transform("days", lambda d: d["sold"])).drop("days")
    base = computed(base, m=full_means("v", window), n=F.size("v"))
    # Residuals of every origin whose whole horizon is observed, step by step; the point is the mean of the last full window.
    steps = base.select(*keys, F.date_add("first", F.col("n") - 1).alias("_end"), F.element_at("m", -1).alias("point"), "v", "m", "n",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    origins = F.greatest(F.col("n") - horizon, F.lit(0))
    resid = F.zip_with(F.slice("m", F.lit(1), origins), F.slice("v", F.col("step") + 1, origins), lambda m, y: y - m)
    rq = computed(steps, r=F.array_sort(F.filter(resid, lambda r: r.isNotNull()))).drop("v", "m")
    order = F.greatest(F.col("point") + array_percentile(F.col("r"), level), F.lit(0.0))
    return rq.filter(F.col("point").isNotNull() & (F.size("r") > 0)).select(
        *keys, "step", F.date_add("_end", F.col("step")).alias("forecasted_date"), order.alias("order"))


def next_month_forecast(sales: DataFrame, **kw) -> DataFrame:
    """P19 + F20 + F21: rows (store_id, item_id, forecasted_date, forecasted_sold) rounded per day."""
    fc = daily_order_forecast(sales, **kw)
    return fc.select(*(kw.get("by") or []), *KEYS, "forecasted_date", half_even("order").alias("forecasted_sold"))


def aggregate_plan(forecast: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F3 + A15 + F4: drop the date, total per (store, item) after per-day rounding (G3), drop zeros."""
    return (forecast.drop("forecasted_date").groupBy(*(by or []), *KEYS)
                    .agg(F.sum("forecasted_sold").alias("forecasted_sold"))
                    .filter(F.col("forecasted_sold") != 0))


def nested_plan(plan: DataFrame) -> DataFrame:
    """P20 + K6: one row per store with map item → quantity (and its JSON text).

    Stores whose whole plan is zero are already gone (G18). A store's map holds at most one
    entry per item it sells.
    """
    entries = F.sort_array(F.collect_list(F.struct("item_id", "forecasted_sold")))
    g = plan.groupBy("store_id").agg(F.map_from_entries(entries).alias("items"))
    return g.withColumn("json", F.to_json("items"))
