"""Filter interaction audit over all orders of a few filters.

A document is reduced to the mask of the filters it fails. Under an order it goes at the first of its failing
filters, so a mask's documents go at step s by filter f under exactly those orders that begin with s - 1 filters
outside the mask and then f. Orders are numbered by their Lehmer rank (place in the lexicographic list); orders with
a common beginning are an interval of ranks. Each (part, mask) adds its counts at the intervals' first ranks and
takes them away behind their ends; prefix sums along the ranks give every order's removals at once. The work on
documents is one pass that counts masks, however many orders there are."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def lehmer_rank(order: str, filters: str = FILTERS) -> int:
    """Place of a permutation of ``filters``, or of the first one with that beginning, in the lexicographic list."""
    left, rank = sorted(filters), 0
    for f in order:
        rank += left.index(f) * math.factorial(len(left) - 1)
        left.remove(f)
    return rank


def order_at(rank: int, filters: str = FILTERS) -> str:
    """The permutation of a Lehmer rank."""
    left, out = sorted(filters), ""
    for k in range(len(left) - 1, -1, -1):
        at, rank = divmod(rank, math.factorial(k))
        out += left.pop(at)
    return out


def removal_intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, first rank behind): where a mask's documents go at that step."""
    out = []
    for mask in range(1, 1 << len(filters)):
        failed = [f for k, f in enumerate(filters) if mask >> k & 1]
        passed = [f for f in filters if f not in failed]
        for before in range(len(passed) + 1):
            for head in itertools.permutations(passed, before):
                for f in failed:
                    first = lehmer_rank("".join(head) + f, filters)
                    out.append((mask, before + 1, first, first + math.factorial(len(filters) - before - 1)))
    return out


def text_failures(text: Column) -> list[Column]:
    """Whether a text (null: empty) fails A: under 200 words, B: under half of its words distinct, C: over 3 % of its
    characters in A-Z, D: one of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " ")
    kept = F.array_remove(words, "")
    n, distinct, chars = (c.cast("long") for c in (F.size(kept), F.size(F.array_distinct(kept)), F.length(t)))
    upper = chars - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * chars,
            t.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, n, good, toxic: documents, and how many of them have labels quality = 1 and toxic = 1.

    Equal texts meet by their digest; which of them repeats a smaller id is settled on counts by (digest, part, mask,
    label, id), summed on the map side, so a hot text or part is spread over all tasks until one row per part and
    label of a digest is left."""
    own = [f.cast("int") * (1 << k) for k, f in enumerate(text_failures(F.col(text_col)))]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"), sum(own[1:], own[0]).alias("mask"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows that repeat an id meet their label as one; rows without an id have none and do not meet at all
    each = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = each.filter("id is not null").join(marks, F.col("id") == F.col("label_id"), "left").select(
        *each.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    nameless = each.filter("id is null").select(*each.columns, F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    cell = ["digest", "part", "mask", "good", "toxic"]
    cells = known.groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.struct("id", F.col("n").alias("k"))).alias("least"))
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    cells = cells.withColumn("k", F.when(first, F.col("least.k")).otherwise(0))
    counts = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("good")).alias("good"), F.sum(F.col("w") * F.col("toxic")).alias("toxic")]
    last = 1 << (len(FILTERS) - 1)
    firsts = cells.select("part", "mask", F.col("k").alias("w"), "good", "toxic")
    copies = cells.select("part", (F.col("mask") + last).alias("mask"), (F.col("n") - F.col("k")).alias("w"), "good", "toxic")
    alone = nameless.select("part", "mask", F.col("n").alias("w"), "good", "toxic")
    return firsts.unionByName(copies).unionByName(alone).groupBy("part", "mask").agg(*counts)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order (120) and step (1 to 5): kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley as counts of documents, zeros included.

    A null text is empty (it fails A and, unless it holds the least id of an empty text, E); a null or empty part is ''.
    A document fails E when a smaller id has the same text: rows that repeat one id do not fail by each other, a row
    without an id neither fails E nor makes others fail, and has no label. Of labels that repeat an id any 1
    counts; null labels are 0. No rows give no rows. Other columns are not read, so their names never clash."""
    spark = docs.sparkSession
    masks = mask_counts(docs, labels, id_col, text_col, part_col)
    bits = [F.col("mask").bitwiseAND(F.lit(1 << k)) > 0 for k in range(len(FILTERS))]
    # per part: its documents, those that fail each filter, and those that fail it alone
    totals = masks.groupBy("part").agg(
        F.sum("n").alias("docs"), F.array(*[F.sum(F.when(b, F.col("n")).otherwise(0)) for b in bits]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == (1 << k), F.col("n")).otherwise(0)) for k in range(len(FILTERS))]).alias("alone"))
    where = spark.createDataFrame(removal_intervals(), "mask int, step int, first int, behind int")
    ends = masks.join(F.broadcast(where), "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("first").alias("rank"), *COUNTS),
        F.struct(F.col("behind").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]))).alias("e"))
    ends = ends.select("part", "step", "e.*").groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS])
    ranks = range(math.factorial(len(FILTERS)))
    names = F.array(*[F.lit(order_at(r)) for r in ranks])
    grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ranks) - 1))).alias("rank")).select(
        "*", F.element_at(names, F.col("rank") + 1).alias("filter_order"),
        F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    grid = grid.withColumn("f", F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1))"))
    along = Window.partitionBy("part", "step").orderBy("rank")
    cut = grid.join(ends, ["part", "step", "rank"], "left").select(
        "part", "filter_order", "step", "rank", "f", "docs", "fails", "alone",
        *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in COUNTS])
    own = lambda c: F.element_at(c, F.col("f"))
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return cut.select("part", "filter_order", "step", (F.col("docs") - gone).alias("kept"), F.col("n").alias("removed"),
                      (own("fails") - F.col("n")).alias("redundant"), own("alone").alias("unique_fails"),
                      F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
                      F.sum("n").over(Window.partitionBy("part", "f")).alias("shapley"))
