"""Quantiles and losses (A1–A6) plus skew-safe exact percentiles.

Two exact percentile paths, both with numpy's default linear interpolation:

* ``group_percentiles`` — one sorted array per group, for groups bounded by the calendar (per series, per
  (series, step)).
* ``selected_percentiles`` — for groups that grow with the data (a statistic across all series of a cell, a
  whole-panel median). The 64 ordered bits of a double are read 16 at a time: a pass counts rows per (group,
  column, digit), combined on the map side, so a hot group or value costs every task at most 65,536 counts; running
  sums over the digits name the one digit each wanted rank lies in, and the next pass counts only rows that begin so.
  Four passes name the value itself. Nothing is sorted, gathered or cut off from its lineage; all columns and levels
  share the passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize


def group_percentiles(df: DataFrame, keys: list[str], value: str, levels, names: list[str]) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value`` per group, NULLs ignored (A1).

    Only for groups bounded by the calendar (per series, per (series, step)): each group's
    values are gathered into one sorted array (JVM-side ``array_sort``) and the two order
    statistics around q·(n−1) are interpolated — numpy's default method. About a quarter faster
    than the ``percentile`` aggregate's per-row hash map on these group sizes.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    n = F.size("_v")
    outs = []
    for q, name in zip(levels, names):
        pos = F.lit(float(q)) * (n - F.lit(1)).cast("double")
        lo = F.element_at("_v", (F.floor(pos) + 1).cast("int"))
        hi = F.element_at("_v", (F.ceil(pos) + 1).cast("int"))
        outs.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return g.select(*keys, *outs)


DIGIT = 16  # bits


def ordered_bits(c: Column) -> Column:
    """A double as a long of the same order (zeros alike, NaN above all)."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def selected_percentiles(df: DataFrame, keys: list[str], columns: dict[str, list[str]], levels, weight: str | None = None) -> DataFrame:
    """Exact percentiles of several columns per group: ``columns`` maps a column to the names of its ``levels``.

    With integer ``weight`` a row counts ``weight`` times (the expanded-sample percentile). NULL values are ignored. Output:
    keys, each column's names and ``n_<column>`` (its total weight); a group has a row if any column has a value.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    group = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*group, w.alias("_w"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])))
    rows = rows.filter(F.col("_v").isNotNull() & (F.col("_w") > 0)).withColumn("_b", ordered_bits(F.col("_v")))

    def digit(k: int) -> Column:
        """The k-th 16 bits; the first with its sign."""
        x = F.shiftright("_b", 64 - DIGIT * (k + 1))
        return x if k == 0 else x.bitwiseAND(F.lit((1 << DIGIT) - 1))

    def cumulated(counts: DataFrame, within: list[str]) -> DataFrame:
        """_before and _n: the weight of smaller digits and of all, within a prefix."""
        w = Window.partitionBy(*within)
        return counts.withColumn("_before", F.sum("_w").over(w.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))).withColumn(
            "_before", F.coalesce("_before", F.lit(0).cast("long"))).withColumn("_n", F.sum("_w").over(w))

    def hit(targets: Column) -> Column:
        """The targets (rank within the prefix) that fall on a digit, with their rank within it."""
        mine = F.filter(targets, lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_w")))
        return F.transform(mine, lambda t: F.struct(t["id"].alias("id"), (t["rank"] - F.col("_before")).alias("rank")))

    first = cumulated(rows.groupBy(*by, "_c", digit(0).alias("_d")).agg(F.sum("_w").alias("_w")), [*by, "_c"])
    at = [F.lit(float(q)) * (F.col("_n") - F.lit(1)).cast("double") for q in levels]
    wanted = F.array(*[F.struct(F.lit(2 * i + side).alias("id"), half(p).cast("long").alias("rank"))
                       for i, p in enumerate(at) for side, half in ((0, F.floor), (1, F.ceil))])
    state = first.select(*by, "_c", "_n", F.col("_d").alias("_p"), hit(wanted).alias("_t")).filter(F.size("_t") > 0)
    for k in range(1, 64 // DIGIT):
        prefix = F.shiftright("_b", 64 - DIGIT * k)
        same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_c", "_p")])
        counted = (rows.withColumn("_p", prefix).alias("r").join(state.alias("s"), same)
                   .groupBy(*[F.col(f"s.{c}").alias(c) for c in (*by, "_c", "_p", "_n")], digit(k).alias("_d"))
                   .agg(F.sum("r._w").alias("_w"), F.first("s._t").alias("_t"), F.max("r._v").alias("_v")))
        inside = cumulated(counted.withColumnRenamed("_n", "_all"), [*by, "_c", "_p"])
        state = inside.select(*by, "_c", F.col("_all").alias("_n"), "_v", hit(F.col("_t")).alias("_t"), F.shiftleft("_p", DIGIT).bitwiseOR(
            F.col("_d")).alias("_p")).filter(F.size("_t") > 0)
    found = state.select(*by, "_c", "_n", "_v", F.explode("_t.id").alias("_id"))
    aggs, outs = [], []
    for i, (c, names) in enumerate(columns.items()):
        own = F.col("_c") == i
        aggs.append(F.max(F.when(own, F.col("_n"))).alias(f"n_{c}"))
        for j, name in enumerate(names):
            aggs += [F.max(F.when(own & (F.col("_id") == 2 * j + side), F.col("_v"))).alias(f"_{i}_{2 * j + side}") for side in (0, 1)]
            pos = F.lit(float(levels[j])) * (F.col(f"n_{c}") - F.lit(1)).cast("double")
            lo, hi = F.col(f"_{i}_{2 * j}"), F.col(f"_{i}_{2 * j + 1}")
            outs.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    got = found.groupBy(*by).agg(*aggs)
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[f"n_{c}" for c in columns], *outs)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, levels, names: list[str],
                      weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """``selected_percentiles`` of one column. Output: keys + ``n`` (total weight) + one column per level.
    ``partitions`` spreads the rows over so many tasks first, where they come in fewer."""
    some = df.repartition(partitions) if partitions else df
    out = selected_percentiles(some, keys, {value: list(names)}, levels, weight)
    return out.withColumnRenamed(f"n_{value}", "n")


def array_percentile(values: Column, q: float) -> Column:
    """Exact percentile of a sorted array without NULLs; NULL of an empty one."""
    n = F.size(values)
    pos = F.lit(float(q)) * (n - F.lit(1)).cast("double")
    lo = F.element_at(values, F.greatest(F.floor(pos) + 1, F.lit(1)).cast("int"))
    hi = F.element_at(values, F.greatest(F.ceil(pos) + 1, F.lit(1)).cast("int"))
    return F.when(n > 0, lo + (pos - F.floor(pos)) * (hi - lo))


def quantile_forecast(point: DataFrame, resid_q: DataFrame, on: list[str], names=("q50", "q_cr")) -> DataFrame:
    """A2 + F23: forecast quantile = point + residual quantile, clipped at zero (NULL stays NULL)."""
    j = point.join(resid_q, on, "left")
    cols = [F.when(F.col("point").isNull() | F.col(f"r_{n}").isNull(), F.lit(None).cast("double"))
             .otherwise(F.greatest(F.col("point") + F.col(f"r_{n}"), F.lit(0.0))).alias(n) for n in names]
    return j.select(*[c for c in point.columns if c != "point"], *cols)


def uncross(lo: str = "q50", hi: str = "q_cr") -> list[Column]:
    """A3 for two levels: sorted pair (least, greatest)."""
    return [F.least(F.col(lo), F.col(hi)).alias(lo), F.greatest(F.col(lo), F.col(hi)).alias(hi)]


def pinball(q: float | Column, demand, forecast) -> Column:
    """Pinball loss of one forecast: max(q·d, (q−1)·d) with d = demand − forecast."""
    qq = q if isinstance(q, Column) else F.lit(float(q))
    d = (F.col(demand) if isinstance(demand, str) else demand) - (F.col(forecast) if isinstance(forecast, str) else forecast)
    return F.greatest(qq * d, (qq - F.lit(1.0)) * d)


def global_rank(df: DataFrame, keys: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its group by ``order`` (ties broken arbitrarily but
    deterministically), computed without gathering a group in one task: rows are range-partitioned on
    (keys, order) and written once, each (partition, group) slice is numbered locally, and the slices'
    totals (groups + partitions rows at most) are summed up to offsets. Adds ``pos`` and the group size ``n``.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(p, *[F.col(k) for k in keys], F.col(order))
                         .withColumn("_pid", F.spark_partition_id()))
    slice_w = Window.partitionBy("_pid", *keys)
    local = (ranged.withColumn("_c", F.row_number().over(slice_w.orderBy(order)) - F.lit(1))
                   .withColumn("_t", F.count(F.lit(1)).over(slice_w)))
    totals = local.groupBy("_pid", *keys).agg(F.first("_t").alias("_t"))
    grp = Window.partitionBy(*keys)
    offsets = totals.select(
        "_pid", *keys,
        F.coalesce(F.sum("_t").over(grp.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0).cast("long")).alias("_off"),
        F.sum("_t").over(grp).alias("n"))
    out = local.join(offsets, ["_pid", *keys])
    return out.withColumn("pos", (F.col("_off") + F.col("_c")).cast("long")).drop("_pid", "_c", "_t", "_off")


def nested_percentiles(df: DataFrame, keys: list[str], value: str, position, cuts, levels,
                       names: list[str]) -> DataFrame:
    """Exact percentiles of ``value`` per group for several nested row sets at once.

    Row set ``f`` holds the rows with ``position < cut_f`` (rolling origins: every earlier origin
    sees a prefix of the later one's history). Each group is gathered and sorted by value once
    (JVM ``array_sort``); each origin filters that sorted array to its prefix and interpolates the
    two order statistics around q·(n−1). No row is replicated per origin. Groups must be bounded
    (here: by the calendar). ``cuts`` is a list of (fold, cut). Returns (fold, cut, keys,
    names...) with NULLs for empty sets.
    """
    pos_col = F.col(position) if isinstance(position, str) else position
    g = (df.filter(F.col(value).isNotNull())
           .groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), pos_col.alias("p")))).alias("_a")))
    per_cut = []
    for f, c in cuts:
        prefix = F.transform(F.filter("_a", lambda x: x["p"] < F.lit(c)), lambda x: x["v"])
        per_cut.append(F.struct(F.lit(f).alias("fold"), F.lit(c).alias("cut"), prefix.alias("_v")))
    x = g.select(*keys, F.inline(F.array(*per_cut)))
    n = F.size("_v")
    outs = []
    for q, name in zip(levels, names):
        pos = F.lit(float(q)) * (n - F.lit(1)).cast("double")
        lo = F.element_at("_v", (F.floor(pos) + 1).cast("int"))
        hi = F.element_at("_v", (F.ceil(pos) + 1).cast("int"))
        outs.append(F.when(n > 0, lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return x.select("fold", "cut", *keys, *outs)
