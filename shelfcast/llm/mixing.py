"""Mixing sources to target weights.

Words of a source are packed into blocks of one length, which is less for a source too small for many of them. The output is a sequence of shards of
``shard_slots`` slots; each shard draws its source counts from a multinomial over the targets, slots of
a source are numbered through all shards, and slot j of a source with nb blocks takes, in pass
j div nb over the source, the block at position j mod nb of a pseudorandom permutation (a Feistel
network, so nothing is shuffled to permute). Slots beyond a source's quota go to sources that the
draw left short, so quotas hold exactly. Slots and blocks meet in a join by (source, block)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, mix64, scratch_table

WEIGHTS = (5, 2, 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, part: list[str], order: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """``out``: the sum of ``value`` over smaller ``order`` within ``part``, in two levels, so that one window
    task never holds more than ``group`` orders' rows of a part, or 1/group of them."""
    g = df.withColumn("__g", F.floor(F.col(order) / group))
    inner = Window.partitionBy(*part, "__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = g.groupBy(*part, "__g").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*part).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    # a struct around each part column lets null parts meet in the join
    keys = [F.struct(F.col(c).alias("v")).alias(f"__{c}") for c in part]
    sums = sums.select(*keys, "__g", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    names = [f"__{c}" for c in part]
    return (g.select("*", *keys).withColumn("__i", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, [*names, "__g"])
            .withColumn(out, F.col("__i") + F.col("__b")).drop("__g", "__i", "__b", *names))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, ..., target) from (source, source_size, ...), one row a source. Sources by code
    point, null last, weigh ``weights`` in turn and share all sizes; a target stops at ``most`` times its
    source's size and the excess is reshared by weight until none is above: with sources sorted by
    cap / weight, the first whose cap reaches its share of what is left fixes the level for the rest."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy("__r", F.col("source").asc_nulls_last())
    up, down = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = sizes.withColumn("weight", w).withColumn("__r", most * F.col("source_size") / F.col("weight"))
    t = t.withColumn("__level", (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(up), F.lit(0.0)))
                     / F.sum("weight").over(down))
    t = t.withColumn("__level", F.max(F.when(F.col("__r") >= F.col("__level"), F.col("__level"))).over(every))
    return t.withColumn("target", F.least(most * F.col("source_size"), F.col("__level") * F.col("weight")).cast("double")).drop("__r", "__level")


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 (one for each seed) sends each index: a 4-round Feistel
    network on the least even number of bits that holds n, walked until the value falls below n."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, n, todo = index.astype(np.uint64), n.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        a, h, m, s = x[todo], half[todo], low[todo], seed[todo]
        left, right = a >> h, a & m
        for r in range(4):
            left, right = right, left ^ (mix64(right * _STEP + s + np.uint64(r)) & m)
        x[todo] = (left << h) | right
        todo &= x >= n
    return x.astype(np.int64)


def draw_shards(shares: list[float], total: int, shard_slots: int, seed: int):
    """mapInPandas over shard ids: (shard, source_no, n), the multinomial source counts of each shard."""
    p = np.array(shares, float)

    def run(frames):
        for f in frames:
            for shard in f["id"]:
                rng = np.random.default_rng([seed, int(shard)])
                n = rng.multinomial(min(shard_slots, total - shard * shard_slots), p)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.int64(shard), "source_no": at.astype(np.int64), "n": n[at].astype(np.int64)})
    return run


def slots_to_blocks(seed: int):
    """mapInPandas over (shard, source_no, start, n, blocks): a row per slot with its pass and block."""
    def run(frames):
        for f in frames:
            for a in range(0, len(f), 256):
                g = f.iloc[a:a + 256]
                n = g["n"].to_numpy()
                at = np.repeat(np.arange(len(g)), n)
                j = g["start"].to_numpy()[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                nb, src = g["blocks"].to_numpy()[at], g["source_no"].to_numpy()[at]
                turn = j // np.maximum(nb, 1)
                key = mix64((src.astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64)) * _STEP + np.uint64(seed))
                yield pd.DataFrame({"shard": g["shard"].to_numpy()[at], "source_no": src, "pass": turn,
                                    "block": permuted(j - turn * nb, nb, key)})
    return run


class Mix:
    """The tables of a mix: ``sources`` (source_no, source, source_size, weight, target, blocks, quota),
    ``spans`` (id, source_no, block, words: what a block holds of a document), ``slots`` (shard, source_no,
    pass, block), ``sized`` (the documents)."""

    def __init__(self, sources, spans, slots, sized):
        self.sources, self.spans, self.slots, self.sized = sources, spans, slots, sized


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block_words: int = 64, shard_slots: int = 4096,
        least_blocks: int = 256, chunk_docs: int = 4096, max_sources: int = 100_000, seed: int = 17) -> Mix:
    """Null texts have size 0 and are in no block; a null source is a source, the last; repeated rows are
    packed as they come; without words there are no slots and targets are 0. A block of a source holds
    ``block_words`` words, or so many fewer (down to one) that there are ``least_blocks`` blocks: quotas are whole
    blocks, so a small source too comes near its target. ``max_sources`` bounds what the
    driver holds (a row per source); more sources raise an error."""
    spark = docs.sparkSession
    sized = scratch_table(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                      n_words(F.col(text_col)).alias("size")), "mix_sizes")
    chunks = max(1, math.ceil(sized.count() / chunk_docs))
    # chunks of a source are packed on their own, so a hot source is spread; each ends in one short block
    placed = sized.withColumn("chunk", F.pmod(F.xxhash64("id", "size"), F.lit(chunks)))
    per_chunk = placed.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    per_source = per_chunk.groupBy("source").agg(F.sum("words").alias("source_size"))
    found = targets(per_source, weights, most).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or group them")
    lengths = [(k, r["source"], max(1, min(block_words, int(r["source_size"] or 0) // least_blocks))) for k, r in enumerate(found)]
    named = F.broadcast(spark.createDataFrame(lengths, "source_no long, __source string, length long"))  # max_sources rows at most
    same = F.col("source").eqNullSafe(F.col("__source"))
    per_chunk = per_chunk.join(named, same).select(
        "source_no", "chunk", F.ceil(F.col("words") / F.col("length")).cast("long").alias("n_blocks"))
    blocks = {r["source_no"]: int(r["n"]) for r in per_chunk.groupBy("source_no").agg(F.sum("n_blocks").alias("n")).collect()}
    listed = []
    for k, r in enumerate(found):
        target = r["target"] or 0.0
        full = int(target // r["source_size"]) if r["source_size"] else 0
        rest = (target - full * r["source_size"]) / r["source_size"] * blocks[k] if r["source_size"] else 0
        quota = min(full * blocks[k] + round(rest), int(most * blocks[k]))
        listed.append((k, r["source"], int(r["source_size"]), float(r["weight"]), float(target), blocks[k], int(quota)))
    sources = spark.createDataFrame(listed, "source_no long, source string, source_size long, weight double, target double, blocks long, quota long")

    first = prefix_sums(per_chunk, ["source_no"], "chunk", "n_blocks", "first_block").select("source_no", "chunk", "first_block")
    order = Window.partitionBy("source_no", "chunk").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (placed.filter("size > 0").join(named, same)
            .withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
            .join(first, ["source_no", "chunk"]))
    n = F.col("length")
    b = laid.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("size") - 1) / n))))
    spans = b.select("id", "source_no", (F.col("first_block") + F.col("k")).alias("block"),
                     (F.least((F.col("k") + 1) * n, F.col("at") + F.col("size")) - F.greatest(F.col("k") * n, F.col("at"))).alias("words"))

    total = sum(r[6] for r in listed)
    shards = math.ceil(total / shard_slots)
    draws = spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(
        draw_shards([r[6] / total for r in listed], total, shard_slots, seed) if total else (lambda frames: iter(())),
        "shard long, source_no long, n long")
    draws = scratch_table(prefix_sums(draws, ["source_no"], "shard", "n", "start"), "mix_draws")
    draws = draws.join(F.broadcast(sources.select("source_no", "blocks", "quota")), "source_no")
    used = draws.withColumn("got", F.greatest(F.least(F.col("quota") - F.col("start"), F.col("n")), F.lit(0)))
    # slots beyond a quota, numbered, meet the numbered places that the draw left free: as many
    over = prefix_sums(used.withColumn("void", F.col("n") - F.col("got")).filter("void > 0")
                       .groupBy("shard").agg(F.sum("void").alias("void")), [], "shard", "void", "v0")
    over = over.select("shard", F.explode(F.sequence(F.col("v0"), F.col("v0") + F.col("void") - 1)).alias("v"))
    have = {r["source_no"]: r["got"] for r in used.groupBy("source_no").agg(F.sum("got").alias("got")).collect()}
    short, v = [], 0
    for r in listed:
        if (miss := r[6] - have.get(r[0], 0)) > 0:
            short.append((r[0], have.get(r[0], 0), miss, v, r[5]))
            v += miss
    free = spark.createDataFrame(short, "source_no long, got long, miss long, v0 long, blocks long")
    free = free.select("source_no", "blocks", F.posexplode(F.sequence("got", F.col("got") + F.col("miss") - 1)).alias("p", "start"), "v0")
    moved = over.join(free.select("source_no", "blocks", "start", (F.col("v0") + F.col("p")).alias("v")), "v")
    cols = ["shard", "source_no", "start", "n", "blocks"]
    runs = used.filter("got > 0").withColumn("n", F.col("got")).select(*cols).unionByName(
        moved.withColumn("n", F.lit(1).cast("long")).select(*cols))
    slots = runs.mapInPandas(slots_to_blocks(seed), "shard long, source_no long, pass long, block long")
    return Mix(sources, spans, slots, sized)


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats
    counted. Rows with the same id share what is taken of them in proportion to nothing else than their
    packing, so repeated rows are counted together and each carries its equal part."""
    m = mix(docs, **options)
    used = m.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = (m.spans.join(used, ["source_no", "block"]).groupBy("id", "source_no")
             .agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    src = F.broadcast(m.sources.select("source_no", F.col("source").alias("__source"), "source_size", "target"))
    rows = m.sized.join(src, F.col("source").eqNullSafe(F.col("__source")))
    copies = rows.groupBy("id", "source_no").agg(F.sum("size").alias("__all"))
    key = lambda d: d.withColumn("__id", F.struct(F.col("id").alias("i"))).drop("id")  # noqa: E731  null ids meet too
    both = key(copies).join(key(taken), ["__id", "source_no"], "left")
    return (key(rows).join(both, ["__id", "source_no"], "left")
            .select(F.col("__id.i").alias("id"), "source", "size", "source_size", "target",
                    F.coalesce(F.floor(F.col("taken") * F.col("size") / F.col("__all")), F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """``docs`` as the mix takes them, in whole documents: a row comes as often as its words are taken, the
    fraction rounded up or down by a hash of its id so that sources stay near their targets."""
    taken = words_taken(docs, id_col=id_col, seed=seed, **options)
    share = F.col("taken") / F.col("size")
    u = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = taken.filter("size > 0").select(F.struct(F.col("id").alias("i")).alias("__id"), F.floor(share + u).cast("int").alias("__times"))
    times = times.filter("__times > 0").groupBy("__id").agg(F.max("__times").alias("__times"))
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.struct(F.col(id_col).alias("i")).alias("__id"))  # no name clashes
    return (whole.join(times, "__id")
            .withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*"))
