"""Window features over a long panel.

All windows share ``partitionBy(sid).orderBy(wk)``; putting several of them in one ``select``
lets Spark sort each series once. Partitions are series, and a series never holds more
rows than the calendar has periods, so windows cannot skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import spread


def series_w() -> Window:
    """partitionBy(sid).orderBy(wk) — built lazily (needs an active session)."""
    return Window.partitionBy("sid").orderBy("wk")


def trailing(k: int) -> Window:
    return series_w().rowsBetween(-(k - 1), 0)


def full_mean(k: int, value: str = "y"):
    """Mean of the last k values, NULL unless all k exist (G8: a missing value voids the window)."""
    w = trailing(k)
    return F.when(F.count(value).over(w) == k, F.avg(value).over(w))


def series_rows(panel: DataFrame) -> DataFrame:
    """One row per series: (sid, wks, ys), arrays in week order, bounded by the calendar."""
    g = spread(panel, "sid").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("wk", "y"))).alias("_p"))
    return computed(g, wks=F.transform("_p", lambda p: p["wk"]), ys=F.transform("_p", lambda p: p["y"])).drop("_p")


def computed(df: DataFrame, **columns) -> DataFrame:
    """``df`` and ``columns``, computed once per row. Plain projections are merged, and an array that a later lambda
    names would then be worked out again for each of the lambda's elements; a generator of one row is not merged."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def full_means(values, k: int):
    """Means of the last k values at each place of an array, NULL unless all k exist."""
    v = F.col(values) if isinstance(values, str) else values
    return F.transform(v, lambda x, i: F.when(i >= k - 1, F.aggregate(
        F.slice(v, F.greatest(i - (k - 2), F.lit(1)), F.lit(k)), F.lit(0.0), lambda a, y: a + y) / F.lit(float(k))))


def seasonal_residuals(panel: DataFrame, m: int) -> DataFrame:
    """y[t] − y[t−m] where both exist → (sid, wk, residual)."""
    r = F.col("y") - F.lag("y", m).over(series_w())
    return panel.select("sid", "wk", r.alias("residual")).filter(F.col("residual").isNotNull())


def trailing_mean(panel: DataFrame, k: int) -> DataFrame:
    """(sid, wk, mean) for full windows ending at wk."""
    return panel.select("sid", "wk", full_mean(k).alias("mean")).filter(F.col("mean").isNotNull())


def moving_average_residuals(panel: DataFrame, k: int, horizon: int) -> DataFrame:
    """Residual of the mean ending at ``wk`` against each of the next ``horizon`` values.

    An origin is kept only when its whole horizon lies inside the panel (``lead(y, H)`` row
    exists); explode happens after that filter. → (sid, wk, step, residual)
    """
    leads = [F.lead("y", s).over(series_w()).alias(f"_l{s}") for s in range(1, horizon + 1)]
    last = F.max("wk").over(Window.partitionBy("sid"))
    base = panel.select("sid", "wk", full_mean(k).alias("_m"), last.alias("_last"), *leads)
    base = base.filter(F.col("_m").isNotNull() & (F.col("wk") + horizon <= F.col("_last")))
    steps = F.array(*[F.struct(F.lit(s).alias("step"), (F.col(f"_l{s}") - F.col("_m")).alias("residual"))
                      for s in range(1, horizon + 1)])
    return (base.select("sid", "wk", F.inline(steps))
                .filter(F.col("residual").isNotNull()))


def sliding_windows(panel: DataFrame, width: int) -> DataFrame:
    """Complete windows of ``width`` values ending at each week → (sid, end_wk, win array)."""
    w = trailing(width)
    win = F.collect_list("y").over(w)
    return (panel.select("sid", F.col("wk").alias("end_wk"), F.count("y").over(w).alias("_n"), win.alias("win"))
                 .filter(F.col("_n") == width).drop("_n"))


def scaled_windows(panel: DataFrame, context: int, horizon: int) -> DataFrame:
    """(sid, end_wk, x, y, scale): x = context inputs, y = horizon targets, both / scale,
    scale = 1 + mean(context inputs). ``end_wk`` is the week of the last target."""
    wins = sliding_windows(panel, context + horizon)
    x = F.slice("win", 1, context)
    y = F.slice("win", context + 1, horizon)
    scale = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.lit(float(context)) + F.lit(1.0)
    out = wins.select("sid", "end_wk", x.alias("x"), y.alias("y"), scale.alias("scale"))
    return out.select("sid", "end_wk",
                      F.transform("x", lambda v: v / F.col("scale")).alias("x"),
                      F.transform("y", lambda v: v / F.col("scale")).alias("y"), "scale")


def design_matrix(windows: DataFrame) -> DataFrame:
    """One row per (window, step): the lag array, a 0-based step id and the step target."""
    return windows.select("sid", "end_wk", "x", "scale", F.posexplode("y").alias("step", "target"))


def latest_context(panel: DataFrame, cut: int, context: int) -> DataFrame:
    """Last ``context`` listed values before ``cut`` per series (ordered), with their scale."""
    recent = panel.filter((F.col("wk") >= cut - context) & (F.col("wk") < cut) & F.col("y").isNotNull())
    g = recent.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("wk", "y"))).alias("_p"))
    x = F.transform("_p", lambda p: p["y"])
    out = g.select("sid", x.alias("context"))
    scale = F.aggregate("context", F.lit(0.0), lambda a, v: a + v) / F.size("context") + F.lit(1.0)
    return out.select("sid", F.size("context").alias("n"), "context", scale.alias("scale"))
