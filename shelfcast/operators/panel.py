"""Panel construction and reshaping.

Panels are long: one row per (series, period). A series never exceeds the calendar length
(days or weeks), so every per-series window or percentile below is bounded by the calendar,
not by the data volume. Raw sales are always pre-aggregated with a partial (map-side)
hash aggregate before any shuffle on the series key, so a hot store or item is combined
on the map side instead of landing in one task.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import PanelSpec
from shelfcast.functions.columns import clip_zero, md5_int, series_id, week_index, week_start
from shelfcast.session import materialize, spread


def series_w() -> Window:
    """partitionBy(sid).orderBy(wk) — built lazily (needs an active session)."""
    return Window.partitionBy("sid").orderBy("wk")


# ---------------------------------------------------------------- daily panel (app) -----

def daily_sums(sales: DataFrame) -> DataFrame:
    """Sum of ``sold`` per (item, store, day)."""
    return (sales.groupBy("item_id", "store_id", "date")
                 .agg(F.sum(F.col("sold").cast("double")).alias("sold")))


def filled(points, first, last, start, value, step=1):
    """Sorted (at, value) points of one series as an array over [first, last]: what is missing is zero. Each point
    covers the places up to the next one, so the work is linear in the calendar, without a join."""
    pts = F.filter(points, lambda p: (p[start] >= first) & (p[start] <= last))
    head = F.array(F.struct(first.alias(start), F.lit(0.0).alias(value)))
    pts = F.when(F.size(pts) == 0, head).when(F.element_at(pts, 1)[start] > first, F.concat(head, pts)).otherwise(pts)
    ends = F.concat(F.slice(F.transform(pts, lambda p: p[start]), 2, 1 << 30), F.array(last + F.lit(step)))
    return F.flatten(F.zip_with(pts, ends, lambda p, e: F.transform(
        F.sequence(p[start], e - F.lit(step)), lambda t: F.struct(t.alias(start), F.when(t == p[start], p[value]).otherwise(F.lit(0.0)).alias(value)))))


def daily_series(sales: DataFrame) -> DataFrame:
    """P1+P2, one row per series: (item_id, store_id, first, days array of (day, sold)), day 0 being the first sale date of
    the whole table and the last day its last, zero-filled — including the days before a series' first sale (G1).

    One pass over the raw sales: the daily sums are written once; the calendar's bounds and the series come from them.
    """
    sums = materialize(daily_sums(sales))
    d0, d1 = sums.agg(F.min("date"), F.max("date")).first()
    if d0 is None:
        d0 = d1 = _dt.date(1970, 1, 1)
    first, last = F.lit(0), F.lit((d1 - d0).days)
    pts = F.array_sort(F.collect_list(F.struct(F.datediff("date", F.lit(d0)).alias("day"), "sold")))
    return (spread(sums.filter(F.col("date").isNotNull()), "item_id", "store_id").groupBy("item_id", "store_id").agg(pts.alias("_p"))
                .select("item_id", "store_id", F.lit(d0).alias("first"), filled(F.col("_p"), first, last, "day", "sold").alias("days")))


def daily_series_by(sales: DataFrame, by: list[str]) -> DataFrame:
    """``daily_series`` for many tables in one: a row per ``by`` and series, with the calendar of its ``by`` group, from
    the group's first sale to its last. Bounds are combined on the map side, so a group with most of the sales is one
    small row; they meet the series in a join, not a window over the group."""
    sums = materialize(sales.filter(F.col("date").isNotNull()).groupBy(*by, "item_id", "store_id", "date")
                       .agg(F.sum(F.col("sold").cast("double")).alias("sold")))
    bounds = sums.groupBy(*by).agg(F.min("date").alias("first"), F.max("date").alias("_last"))
    series = sums.groupBy(*by, "item_id", "store_id").agg(F.collect_list(F.struct("date", "sold")).alias("_s"))
    placed = series.join(bounds, by).select(
        *by, "item_id", "store_id", "first", F.datediff("_last", "first").alias("_n"),
        F.array_sort(F.transform("_s", lambda p: F.struct(F.datediff(p["date"], F.col("first")).alias("day"), p["sold"].alias("sold")))).alias("_p"))
    return spread(placed, *by, "item_id", "store_id").select(
        *by, "item_id", "store_id", "first", filled(F.col("_p"), F.lit(0), F.col("_n"), "day", "sold").alias("days"))


def daily_panel(sales: DataFrame) -> DataFrame:
    """P1+P2: dense (item_id, store_id, date, sold): observed series × calendar (R14), never all items × all stores."""
    return daily_series(sales).select("item_id", "store_id", "first", F.inline("days")).select(
        "item_id", "store_id", F.date_add("first", F.col("day")).alias("date"), "sold")


# ---------------------------------------------------------------- weekly panel ----------

def weekly_sums(sales: DataFrame, spec: PanelSpec, clip_returns: bool = False) -> DataFrame:
    """(sid, wk, y) summed per series-week over every week with a sale.

    ``clip_returns`` clips each row at zero *before* summing (F11), as the long-CSV loader does.
    Weeks outside [0, weeks) are kept here and dropped by the spine in ``densify_weeks`` (P5), so
    the series list and the sums come from this one aggregate (one pass over the raw sales).
    """
    y = clip_zero("sold") if clip_returns else F.col("sold").cast("double")
    rows = sales.select(series_id("store_id", "item_id").alias("sid"),
                        week_index("date", spec.epoch).alias("wk"), y.alias("y"))
    return rows.groupBy("sid", "wk").agg(F.sum("y").alias("y"))


def densify_weeks(sums: DataFrame, spec: PanelSpec) -> DataFrame:
    """P5 + P7 (internal form): observed series × weeks [0, weeks), missing weeks → 0.

    One array per series, bounded by the calendar, filled and laid out again: no spine and no join. A series whose
    sums all lie outside the kept weeks comes as zeros.
    """
    pts = F.array_sort(F.collect_list(F.struct("wk", F.coalesce("y", F.lit(0.0)).alias("y"))))
    dense = filled(F.col("_p"), F.lit(0), F.lit(spec.weeks - 1), "wk", "y")
    return (sums.filter(F.col("wk").isNotNull()).groupBy("sid").agg(pts.alias("_p")).select("sid", F.inline(dense))
                .select("sid", "wk", week_start("wk", spec.epoch).alias("week_start"), "y"))


def calendar_of(lo: _dt.date | None, hi: _dt.date | None, spec: PanelSpec) -> PanelSpec:
    """``spec`` with the calendar from ``lo`` to ``hi``: its weeks (counted from its epoch, back or forth) from
    that of the first sale date to the last one that the sales fill; only a partial last week is left out.

    No sales: ``spec`` as it is. A table without a whole week raises.
    """
    if lo is None:
        return spec
    epoch = spec.epoch + _dt.timedelta(days=(lo - spec.epoch).days // 7 * 7)
    weeks = ((hi - epoch).days + 1) // 7
    if weeks < 1:
        raise ValueError(f"no whole week of sales between {lo} and {hi}")
    return replace(spec, epoch=epoch, weeks=weeks)


def sale_calendar(sales: DataFrame, spec: PanelSpec) -> PanelSpec:
    """``calendar_of`` the sale dates: one aggregate with one row on the driver."""
    return calendar_of(*sales.agg(F.min(F.col("date").cast("date")), F.max(F.col("date").cast("date"))).first(), spec)


def weekly_sums_and_calendar(sales: DataFrame, spec: PanelSpec, clip_returns: bool = False) -> tuple[DataFrame, PanelSpec]:
    """(weekly sums, calendar of the sales) from one pass over the raw sales: the sums carry their first and last sale
    date, are written once and counted from the calendar's first week afterwards."""
    y = clip_zero("sold") if clip_returns else F.col("sold").cast("double")
    rows = sales.select(series_id("store_id", "item_id").alias("sid"), week_index("date", spec.epoch).alias("wk"),
                        F.col("date").cast("date").alias("date"), y.alias("y"))
    sums = materialize(rows.groupBy("sid", "wk").agg(F.sum("y").alias("y"), F.min("date").alias("lo"), F.max("date").alias("hi")))
    own = calendar_of(*sums.agg(F.min("lo"), F.max("hi")).first(), spec)
    shift = (own.epoch - spec.epoch).days // 7
    return sums.select("sid", (F.col("wk") - shift).alias("wk"), "y"), own


def weekly_panel(sales: DataFrame, spec: PanelSpec, clip_returns: bool = False) -> DataFrame:
    """Dense weekly panel (sid, wk, week_start, y), zero-filled, over every series that has a sale
    (also a sale outside the kept weeks, like an unstack of all totals followed by a column cut)."""
    return densify_weeks(weekly_sums(sales, spec, clip_returns), spec)


def listed_panel(panel: DataFrame) -> DataFrame:
    """P8 + F16: y becomes NULL until the series' first sale (running sum still zero)."""
    listed = F.sum("y").over(series_w().rowsBetween(Window.unboundedPreceding, 0)) > 0
    return panel.withColumn("y", F.when(listed, F.col("y")))


def eligibility(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """P9–P10 per series: first selling week, recent-window sum, established, active.

    One grouped aggregate (no window): first_wk = min(wk where y > 0).
    """
    lo, hi = spec.active_weeks
    agg = panel.groupBy("sid").agg(
        F.min(F.when(F.col("y") > 0, F.col("wk"))).alias("first_wk"),
        F.sum(F.when(F.col("wk").between(lo, hi), F.col("y")).otherwise(F.lit(0.0))).alias("recent_sum"))
    return (agg.withColumn("established", F.coalesce(F.col("first_wk") <= spec.established_week, F.lit(False)))
               .withColumn("active", F.col("recent_sum") > 0))


def eligible_series(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Established ∧ active → (sid, first_wk, recent_sum)."""
    return (eligibility(panel, spec).filter("established AND active")
            .select("sid", "first_wk", "recent_sum"))


def sample_series(eligible: DataFrame, n: int, seed: int, strict: bool = True) -> DataFrame:
    """A seeded uniform sample of ``n`` series without replacement.

    Draw = md5(seed:sid); the sample is the n smallest draws (ties by sid). This is a top-k
    (TakeOrderedAndProject: per-partition top n, then a merge of n·partitions rows), so the
    cost stays bounded by n. With ``strict`` an explicit error is raised when fewer than n
    series are eligible (G16); the check counts through a capped limit so it never scans more
    than n + 1 ids.
    """
    if strict:
        have = eligible.select("sid").limit(n + 1).count()
        if have < n:
            raise ValueError(f"cannot sample {n} series: only {have} eligible")
    return (eligible.select("sid", md5_int(F.lit(seed), F.col("sid")).alias("draw"))
                    .orderBy("draw", "sid").limit(n).select("sid"))


def restrict(panel: DataFrame, ids: DataFrame) -> DataFrame:
    """Keep only the chosen series (left-semi join)."""
    return panel.join(ids.select("sid"), "sid", "left_semi")


def forecast_panel(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """The model panel: listed mask over the eligible series (sid, wk, week_start, y)."""
    return restrict(listed_panel(panel), eligible_series(panel, spec))


def align_to_panel(forecasts: DataFrame, panel: DataFrame, cut: int, horizon: int) -> DataFrame:
    """The forecasts of exactly the panel's series and the weeks [cut, cut + horizon).

    A full outer join of what is there with what is wanted; a (sid, wk) that is missing, comes twice or that the panel does not
    have raises when the rows are read.
    """
    want = panel.groupBy("sid").agg(F.lit(1).alias("_want")).select(
        "sid", F.explode(F.sequence(F.lit(cut), F.lit(cut + horizon - 1))).alias("wk"), "_want")
    have = forecasts.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("sid", "wk")))
    both = have.join(want, ["sid", "wk"], "full_outer")
    place = F.concat_ws(" week ", "sid", F.col("wk").cast("string"))
    checked = (F.when(F.col("_want").isNull(), F.raise_error(F.concat(F.lit("forecast outside the panel: "), place)))
                .when(F.col("_times").isNull(), F.raise_error(F.concat(F.lit("no forecast for "), place)))
                .when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("more than one forecast for "), place)))
                .otherwise(F.col("sid").cast("string")))
    # the series id hangs on the check, so that the optimizer cannot prune it
    return both.withColumn("sid", checked).select(*forecasts.columns)


def long_frame(panel: DataFrame) -> DataFrame:
    """P18 + F17: (unique_id, ds, y) without missing values."""
    return (panel.filter(F.col("y").isNotNull())
                 .select(F.col("sid").alias("unique_id"), F.col("week_start").alias("ds"), "y"))


def series_starts(panel: DataFrame) -> DataFrame:
    """First listed week_start per series."""
    return panel.groupBy("sid").agg(F.min(F.when(F.col("y").isNotNull(), F.col("week_start"))).alias("start"))


def series_arrays(panel: DataFrame) -> DataFrame:
    """P15 + P17: per series {start, target}; target = listed values ordered by week.

    One row per series holding at most ``weeks`` values: bounded by the calendar.
    """
    listed = panel.filter(F.col("y").isNotNull())
    return (listed.groupBy("sid")
                  .agg(F.min("week_start").alias("start"),
                       F.sort_array(F.collect_list(F.struct("wk", "y"))).alias("_pts"))
                  .select("sid", "start", F.transform("_pts", lambda p: p["y"]).alias("target")))


def split_train_test(panel: DataFrame, cut: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """history = wk < cut; truth = cut ≤ wk < cut + horizon."""
    return (panel.filter(F.col("wk") < cut),
            panel.filter((F.col("wk") >= cut) & (F.col("wk") < cut + horizon)))


def at_origins(cuts, keep):
    """Generator of (fold, cut): the rolling origins for whose cut ``keep`` holds."""
    all_ = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut")) for f, c in cuts])
    return F.inline(F.filter(all_, lambda o: keep(o["cut"])))


def cuts_frame(spark, spec: PanelSpec, include_test: bool = True) -> DataFrame:
    """Rolling origins as rows: fold f (1..folds) forecasts from W−(f+1)H; fold 0 = test, W−H."""
    rows = [(f, spec.fold_cut(f)) for f in range(1, spec.folds + 1)]
    if include_test:
        rows.append((0, spec.test_cut))
    return spark.createDataFrame(rows, "fold int, cut int")


def fold_splits(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per (fold, sid) training rows/sum (wk < cut) and truth sum (next H weeks).

    Origins are a literal array of ``folds`` entries; a row keeps those it belongs to, without a join.
    """
    h = spec.horizon
    cuts = [(f, spec.fold_cut(f)) for f in range(1, spec.folds + 1)]
    joined = panel.select("*", at_origins(cuts, lambda cut: F.col("wk") < cut + F.lit(h)))
    train = F.col("wk") < F.col("cut")
    return (joined.groupBy("fold", "sid")
                  .agg(F.count(F.when(train & F.col("y").isNotNull(), 1)).alias("n_train"),
                       F.sum(F.when(train, F.col("y"))).alias("sum_train"),
                       F.sum(F.when(~train, F.col("y"))).alias("sum_truth")))


def pivot_weeks(panel: DataFrame, weeks: list[int]) -> DataFrame:
    """P7 export: one column per listed week (``w<k>``), zero-filled."""
    wide = (panel.filter(F.col("wk").isin(weeks)).groupBy("sid")
                 .pivot("wk", weeks).agg(F.sum("y")))
    return wide.select("sid", *[F.coalesce(F.col(str(w)), F.lit(0.0)).alias(f"w{w}") for w in weeks])


def unpivot_days(wide: DataFrame, id_col: str = "id", prefix: str = "d_") -> DataFrame:
    """Wide daily frame (id, …, d_1..d_N) → long (id, day, y), day index from the name.

    Columns before ``d_1`` are ignored; day columns are taken in file order.
    """
    day_cols = [c for c in wide.columns if c.startswith(prefix)]
    tails = [c.rpartition("_")[2] for c in day_cols]
    numbers = F.lit([int(t) if t.isdigit() else None for t in tails])
    # the line's days as one array: a generator over it, not one projection per day
    return wide.select(F.col(id_col).alias("id"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in day_cols])).alias("_at", "y")).select(
        "id", F.get(numbers, F.col("_at")).cast("int").alias("day"), "y")


def days_by_series(sales: DataFrame, epoch, n_days: int) -> DataFrame:
    """One row per series: (id, days), the array of the ``n_days`` days from ``epoch`` on, zero where nothing sold."""
    series = daily_series(sales).select(F.concat_ws("_", "store_id", "item_id").alias("id"), "days",
                                        F.datediff("first", F.lit(epoch)).alias("_ahead"))
    # each array once per series: the lambda and the columns written from it name it thousands of times
    once = series.select("id", "_ahead", F.inline(F.array(F.struct(F.transform("days", lambda d: d["sold"]).alias("_v")))))
    placed = F.transform(F.sequence(F.lit(0), F.lit(n_days - 1)), lambda i: F.coalesce(F.get("_v", i - F.col("_ahead")), F.lit(0.0)))
    return once.select("id", F.inline(F.array(F.struct(placed.alias("days")))))


def weekly_from_days(long_days: DataFrame, n_days: int, epoch) -> DataFrame:
    """P4 + P5: 7-day block sums of a day-indexed long frame, partial last week dropped."""
    weeks = n_days // 7
    return (long_days.select("id", F.floor((F.col("day") - 1) / 7).cast("int").alias("wk"), "y")
                     .filter(F.col("wk") < weeks)
                     .groupBy("id", "wk").agg(F.sum("y").alias("y"))
                     .select(F.col("id").alias("sid"), "wk", week_start("wk", epoch).alias("week_start"), "y"))
