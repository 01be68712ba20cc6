"""Exact deduplication with a heavy-hitter split.

Texts are compared by the SHA-256 of their ASCII-lower-cased form. A Misra-Gries summary per
partition (summaries add up) names every digest that may hold ``share`` of the rows; an exact
count verifies them. The verified winners (at most 1/share rows) are broadcast, so rows of a hot
group are settled on the map side. All other digests, each with fewer than ``share`` of the rows,
are grouped by an ordinary shuffle of (id, digest)."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, scratch_scope, scratch_table


def misra_gries(counters: int):
    """Partition summary of a string column ``digest``: at most ``counters`` (digest, lower bound)."""
    def run(batches):
        kept: Counter = Counter()
        for b in batches:
            kept.update(Counter(b.column(0).to_pylist()))
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({k: v - cut for k, v in kept.items() if v > cut})
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.string()),
                                          "n": pa.array(list(kept.values()), pa.int64())})
    return run


def heavy_digests(digests: DataFrame, share: float) -> DataFrame:
    """(digest, n, keep) of the digests that hold ``share`` of all rows or more: 1/share at most."""
    total = digests.count()
    counters = math.ceil(2 / share)  # an error of share/2 of the rows at most
    names = (digests.select("digest").mapInArrow(misra_gries(counters), "digest string, n long")
             .groupBy("digest").agg(F.sum("n").alias("low"))
             .filter(F.col("low") >= share * total / 2).select("digest"))
    counted = (digests.join(F.broadcast(names), "digest").groupBy("digest")
               .agg(F.count("*").alias("n"), F.max("id").alias("keep")))
    return scratch_table(counted.filter((F.col("n") >= share * total) & (F.col("n") > 1)), "heavy_digests")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: <id_col>, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts are one group. A null id loses to any
    other; where rows repeat the winning id, one of them is kept. No rows give no rows; other
    columns are not read. ``share`` bounds the broadcast (1/share rows); it never changes a result."""
    digest = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = scratch_table(docs.select(F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    heavy = F.broadcast(heavy_digests(rows, share))
    hot = rows.join(heavy, "digest")
    won = F.col("id").eqNullSafe(F.col("keep"))
    lost = hot.filter(~won).select("id", "digest", "keep", "n", F.lit(False).alias("kept"))
    best = hot.filter(won).select("id", "digest", "keep", "n", (
        F.row_number().over(Window.partitionBy("digest").orderBy("id")) == 1).alias("kept"))
    group = Window.partitionBy("digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").select(
        "id", "digest", F.max("id").over(group).alias("keep"), F.count("*").over(group).alias("n"),
        (F.row_number().over(group.orderBy(F.col("id").desc_nulls_last())) == 1).alias("kept"))
    return lost.unionByName(best).unionByName(rest).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.001) -> DataFrame:
    """``docs`` with one row of each group of equal texts (the largest id; of rows that repeat it, any), all columns
    unchanged whatever their names. Null and empty texts are one group; a row without an id stays only where no row of
    its group has one. No rows give no rows.

    Only keys of the rows that go travel; texts are read again and pass by a join with them."""
    with scratch_scope(docs.sparkSession) as keep:
        groups = exact_groups(docs, id_col, text_col, share).filter("group_size > 1")
        gone = groups.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).agg(
            F.max("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
        gone = keep(gone.select("id", "digest", "stays"), "exact_copies")
    digest = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    named = gone.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest"), "stays")
    rest = rows.join(broadcast_if_small(named.drop("stays"), 100), same, "left_anti").select("row.*")
    repeated = named.filter("stays").drop("stays")
    if not repeated.take(1):
        return rest
    # rows that repeat the id that stays: one of them
    again = rows.join(broadcast_if_small(repeated, 100), same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
    return rest.unionByName(again)
