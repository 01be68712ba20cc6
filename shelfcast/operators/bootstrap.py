"""Paired bootstrap significance (T11–T13, R12, R13) with replicate weights as vectors.

The series of a dataset are numbered by their sorted ids and cut into slices of ``SLICE`` positions; replicates
are cut into blocks. How often a replicate draws each series of a slice is a matrix (series × replicates) that a
task derives from the seed alone, so weights are never shuffled. A replicate makes n draws: draw i falls on position
u(b, i) mod n, which decides its slice; the slice's draws are then dealt over the slice, draw j going to its
position u(b, slice, j) mod (size of the slice). Both are uniform, so the n draws are independent and uniform over
the series, as if drawn at once, and a slice needs only the number of draws that fell into it.

Means and ratios need per cell, slice and block one vector of sums. Medians need the few series near a
cell's median as candidates (one weight vector each) and one vector of the weights below them; replicates whose
median lies outside are redone with wider candidates, so every median is exact. Shuffled are vectors in proportion to
slices × replicates, and candidates in proportion to the root of the number of series.

``draw_hash`` has 64 bits, so the rest of the division favours no series at any size of data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import N_RESAMPLES, SEED
from shelfcast.operators.quantiles import global_rank
from shelfcast.session import materialize

CELL = ["dataset", "model", "regime"]
METRICS = ("MASE", "MASE_median", "cost_per_unit")
SLICE = 4096       # positions
BLOCK = 1250       # replicates
DRAW_CHUNK = 1 << 20
TIE = 9            # decimals: what differs by less only differs by the order of additions
WIDTH = 6          # of the candidates of a median, in roots of the number of series to either side

# Odd multipliers of the hash, below 2**62 so that SQL can multiply in 128 bits.
K_REPLICATE, K_DRAW, K_SLICE, K_SEED = 0x1E3779B97F4A7C15, 0x2545F4914F6CDD1D, 0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35
M_FIRST, M_SECOND = 0x3F58476D1CE4E5B9, 0x14D049BB133111EB


def draw_hash(seed: int, b, place: int, i) -> np.ndarray:
    """64 random bits of draw ``i`` of replicate ``b``; ``place`` is 0 for the draw of the slice, else slice + 1."""
    with np.errstate(over="ignore"):
        z = (np.asarray(b).astype(np.uint64) * np.uint64(K_REPLICATE) + np.asarray(i).astype(np.uint64) * np.uint64(K_DRAW)
             + np.uint64(place * K_SLICE % 2**64) + np.uint64(seed * K_SEED % 2**64))
        for shift, factor in ((32, M_FIRST), (29, M_SECOND)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(32))


@dataclass(frozen=True)
class Layout:
    """How the draws of ``resamples`` replicates are cut into tasks."""

    resamples: int
    seed: int = SEED
    slice: int = SLICE
    block: int = BLOCK

    @property
    def blocks(self) -> int:
        return max(1, math.ceil(self.resamples / self.block))

    def slices(self, n: int) -> int:
        return -(-n // self.slice)

    def replicates(self, block: int) -> list[int]:
        """Replicates of a block; the observed sample (-1) comes with the first."""
        own = list(range(block * self.block, min((block + 1) * self.block, self.resamples)))
        return [-1, *own] if block == 0 else own

    def slice_draws(self, block: int, n: int, first: int, behind: int) -> np.ndarray:
        """(replicates of the block × slices): how many of the draws ``first`` to ``behind`` fall into each slice."""
        replicates = self.replicates(block)
        out = np.zeros((len(replicates), self.slices(n)), np.int64)
        for k, b in enumerate(replicates):
            if b < 0 or out.shape[1] == 1:
                out[k] = 0 if b < 0 else behind - first
                continue
            for at in range(first, behind, DRAW_CHUNK):
                pos = draw_hash(self.seed, b, 0, np.arange(at, min(at + DRAW_CHUNK, behind))) % np.uint64(n)
                out[k] += np.bincount((pos // np.uint64(self.slice)).astype(np.int64), minlength=out.shape[1])
        return out

    def weights(self, block: int, draws: np.ndarray, n: int, slice_no: int) -> np.ndarray:
        """(positions of the slice × replicates of the block): how often each is drawn, ``draws`` being the slice's draws of
        each replicate. The observed sample weighs every series 1."""
        size = min(self.slice, n - slice_no * self.slice)
        replicates = self.replicates(block)
        out = np.zeros((len(replicates), size))
        for k, (b, m) in enumerate(zip(replicates, draws)):
            if b < 0:
                out[k] = 1
                continue
            for at in range(0, int(m), DRAW_CHUNK):
                pos = draw_hash(self.seed, b, slice_no + 1, np.arange(at, min(at + DRAW_CHUNK, int(m)))) % np.uint64(size)
                out[k] += np.bincount(pos.astype(np.int64), minlength=size)
        return out.T


def positions(per_series: DataFrame) -> DataFrame:
    """Series positions per dataset (sorted ids) with a count check across cells.

    Every cell of a dataset must score exactly the dataset's series, each once; otherwise this raises.
    """
    ids = per_series.select("dataset", "sid").distinct()
    ranked = global_rank(ids, ["dataset"], "sid")
    per_cell = per_series.groupBy(*CELL).agg(F.countDistinct("sid").alias("_k"), F.count("sid").alias("_r"))
    check = (per_cell.join(ranked.select("dataset", "n").distinct(), "dataset")
                     .select(*CELL, F.when((F.col("_k") != F.col("n")) | (F.col("_r") != F.col("n")),
                                           F.raise_error(F.lit("cells score different series")))
                                      .otherwise(F.lit(True)).alias("_ok")))
    checked = ranked.join(check.groupBy("dataset").agg(F.min("_ok").alias("_ok")), "dataset")
    # the position hangs on the check, so that the optimizer cannot prune it
    return checked.withColumn("pos", F.when(F.col("_ok"), F.col("pos"))).drop("_ok")


# M8: metric name → (per-series fields, its value from the vectors of a cell's sums). The vectors hold one entry per
# replicate: weighted sums of the fields, and for a field that may be NULL the weight of the series that have it.
METRIC_REGISTRY = {
    "MASE": (("mase",), lambda s: _ratio(s["mase"], s["mase_weight"])),
    "MASE_median": (("mase",), None),  # an order statistic: see ``medians``
    "cost_per_unit": (("cost", "demand"), lambda s: _ratio(s["cost"], s["demand"])),
}
SUMS = ("mase", "mase_weight", "cost", "demand", "below")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def packed(weights: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, after a byte that names it."""
    top = int(weights.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 8
    return bytes([width]) + weights.astype(f"u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def drawn_slices(pos: DataFrame, layout: Layout) -> DataFrame:
    """(dataset, block, slice, draws): draws of each of the block's replicates that fall into a slice. Work is dealt by
    replicate and by ranges of draws; the counts are slices × replicates numbers, whatever the number of draws."""
    sizes = pos.groupBy("dataset").agg(F.max("n").alias("n"))
    span = 1 << 24

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                counts = layout.slice_draws(int(r.block), int(r.n), int(r.part) * span, min(int(r.n), (int(r.part) + 1) * span))
                for s in range(counts.shape[1]):
                    yield pd.DataFrame({"dataset": [r.dataset], "block": [r.block], "slice": [s], "draws": [counts[:, s].tolist()]})
    todo = sizes.select("dataset", "n", F.explode(F.sequence(F.lit(0), F.lit(layout.blocks - 1))).alias("block")).select(
        "dataset", "n", "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / span).cast("int"))).alias("part"))
    counts = todo.repartition(F.col("dataset"), F.col("block"), F.col("part")).mapInPandas(
        run, "dataset string, block int, slice int, draws array<long>")
    if sizes.agg(F.max("n")).first()[0] <= span:
        return counts
    per = counts.select("dataset", "block", "slice", F.posexplode("draws").alias("k", "m")).groupBy(
        "dataset", "block", "slice", "k").agg(F.sum("m").alias("m"))
    return per.groupBy("dataset", "block", "slice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("draws"))


def median_ranks(per_series: DataFrame) -> DataFrame:
    """(cell, sid, rank, known): the place of each series with a MASE among its cell's, and how many there are."""
    ranked = global_rank(per_series.filter(F.col("mase").isNotNull()).select(*CELL, "sid", "mase"), CELL, "mase")
    return ranked.select(*CELL, "sid", F.col("pos").alias("rank"), F.col("n").alias("known"))


def cell_vectors(rows: DataFrame, draws: DataFrame, layout: Layout, median: bool, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(sums, candidates). sums: (cell, block, slice, one vector per entry of ``SUMS``); candidates of the median: (cell, block,
    rank, mase, weights). ``rows``: (cell, sid, pos, n, cost, demand, mase, rank, known)."""
    cut = F.col("known") / 2
    reach = F.ceil(F.lit(width) * F.sqrt("known")) + 8
    rows = rows.select(*CELL, "pos", "n", "cost", "demand", "mase", F.floor(F.col("pos") / layout.slice).cast("int").alias("slice"), "rank",
                       F.coalesce(F.col("rank") < cut - reach, F.lit(False)).alias("under"), F.abs(F.col("rank") - cut).cast("double").alias("_d"),
                       reach.cast("double").alias("_r"))
    rows = rows.withColumn("near", F.coalesce(~F.col("under") & (F.col("_d") <= F.col("_r")), F.lit(False))).drop("_d", "_r")
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(layout.blocks - 1))).alias("block"))
    schema = ("dataset string, model string, regime string, block int, slice int, rank long, value double, weights binary, "
              + ", ".join(f"{c} array<double>" for c in SUMS))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame()
        dataset, block, slice_no = key[0], int(key[1]), int(key[2])
        weights = layout.weights(block, right["draws"].iloc[0], int(left["n"].iloc[0]), slice_no)
        out = []
        for (model, regime), g in left.groupby(["model", "regime"], sort=True):
            g = g.sort_values("pos")
            w = weights[(g["pos"] - slice_no * layout.slice).to_numpy()]
            known = g["mase"].notna().to_numpy()
            vectors = {"mase": np.where(known, g["mase"], 0.0) @ w, "mase_weight": known.astype(float) @ w, "cost": g["cost"].to_numpy(float) @ w,
                       "demand": g["demand"].to_numpy(float) @ w, "below": (known & g["under"].to_numpy(bool)).astype(float) @ w}
            out.append({"dataset": dataset, "model": model, "regime": regime, "block": block, "slice": slice_no, **vectors})
            if median:
                for i in np.flatnonzero(known & g["near"].to_numpy(bool)):
                    out.append({"dataset": dataset, "model": model, "regime": regime, "block": block, "slice": -1,
                                "rank": int(g["rank"].iloc[i]), "value": float(g["mase"].iloc[i]), "weights": packed(w[i])})
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        return frame.astype(object).where(frame.notna(), None)

    key = ["dataset", "block", "slice"]
    both = materialize(spread.groupBy(*key).cogroup(draws.groupBy(*key)).applyInPandas(run, schema))
    sums = both.filter("slice >= 0").select(*CELL, "block", "slice", *SUMS)
    near = both.filter("slice < 0").select(*CELL, "block", "rank", "value", "weights")
    return sums, near


def add_slices(sums: DataFrame, slices: int, arity: int = 64) -> DataFrame:
    """One row per (cell, block): vectors added up in the order of the slices, ``arity`` at a time, so that cells with equal
    scores get equal sums to the last bit."""
    def total(c: str):
        vectors = F.transform("_s", lambda x: x[c])
        return F.aggregate(vectors, F.transform(F.element_at(vectors, 1), lambda v: v * 0),
                           lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias(c)
    while True:
        slices = -(-slices // arity)
        sums = (sums.withColumn("_g", F.floor(F.col("slice") / arity).cast("int")).groupBy(*CELL, "block", "_g")
                .agg(F.array_sort(F.collect_list(F.struct("slice", *SUMS)), lambda x, y: x["slice"] - y["slice"]).alias("_s"))
                .select(*CELL, "block", F.col("_g").alias("slice"), *[total(c) for c in SUMS]))
        if slices <= 1:
            return sums.drop("slice")


def replicate_stats(per_series: DataFrame, pos: DataFrame, layout: Layout, metrics=METRICS, width: int = WIDTH) -> DataFrame:
    """T13 per (cell, b): the metrics of every replicate; b = -1 is the observed sample."""
    median = "MASE_median" in metrics
    n = pos.agg(F.max("n")).first()[0] or 0
    spark = per_series.sparkSession
    out_schema = "dataset string, model string, regime string, b int, " + ", ".join(f"{m} double" for m in metrics)
    if not n:
        return spark.createDataFrame([], out_schema)
    rows = per_series.join(pos.select("dataset", "sid", "pos", "n"), ["dataset", "sid"])
    if median:
        rows = rows.join(median_ranks(per_series), [*CELL, "sid"], "left")
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("long")).withColumn("known", F.lit(None).cast("long"))
    sums, near = cell_vectors(rows, drawn_slices(pos, layout), layout, median, width)
    sums = add_slices(sums, layout.slices(n))
    plain = [m for m in metrics if METRIC_REGISTRY[m][1] is not None]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dataset, model, regime, block = key
        s = {c: np.asarray(left[c].iloc[0], float) for c in SUMS}
        out = {"dataset": dataset, "model": model, "regime": regime, "b": layout.replicates(int(block))}
        out |= {m: METRIC_REGISTRY[m][1](s) for m in plain}
        if median:
            out["MASE_median"], out["_miss"] = medians(right.sort_values("rank"), s["below"], s["mase_weight"])
        return pd.DataFrame(out)

    key = [*CELL, "block"]
    stats = materialize(sums.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(run, out_schema + (", _miss boolean" if median else "")))
    if not median:
        return stats
    if stats.filter("_miss").limit(1).count():
        return replicate_stats(per_series, pos, layout, metrics, width * 4 + 1)
    return stats.drop("_miss")


def medians(near: pd.DataFrame, below: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted median of each replicate, whether it lies outside the candidates): the middle one or the mean
    of the two middle ones of the values, each taken as often as it is drawn."""
    value = near["value"].to_numpy(float)
    up = below + np.cumsum(np.stack([unpacked(w) for w in near["weights"]]).astype(np.int64), axis=0) if len(near) else np.zeros((0, len(below)))
    out = []
    miss = np.zeros(len(below), bool)
    for half in (np.floor, np.ceil):
        rank = half((total - 1) / 2)  # the rank-th value is the first with more than rank values up to it
        at = (up <= rank).sum(0) if len(near) else np.zeros(len(below), int)
        miss |= (total > 0) & ((rank < below) | (at >= len(value)))
        out.append(value[np.minimum(at, len(value) - 1)] if len(near) else np.full(len(below), np.nan))
    mid = out[0] + ((total - 1) / 2 - np.floor((total - 1) / 2)) * (out[1] - out[0])
    return np.where(total > 0, mid, np.nan), miss


def paired_tests(stats: DataFrame, pairs: DataFrame | None = None, metrics=METRICS, n: DataFrame | None = None) -> DataFrame:
    """T11 + R13: for every pair (A < B within a dataset, or the given ``pairs``) and metric:
    a, b, diff = a − b on the observed sample, and the two-sided bootstrap p-value
    min(1, 2·min(P(diff* ≤ 0), P(diff* ≥ 0))) with ties counted on both sides (G14).
    """
    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("dataset", F.col("model").alias(f"model_{x}"), F.col("regime").alias(f"regime_{x}"),
                         "b", *[F.col(m).alias(f"{m}_{x}") for m in metrics])

    if pairs is None:
        cells = stats.filter(F.col("b") == -1)
        pairs = (side(cells, "a").select("dataset", "model_a", "regime_a")
                 .join(side(cells, "b").select("dataset", "model_b", "regime_b"), "dataset")
                 .filter(F.struct("model_a", "regime_a") < F.struct("model_b", "regime_b")))
    # The pairs of cells meet first, the replicates then: no row is made for a pair that is not wanted.
    key = ["dataset", "model_a", "regime_a", "model_b", "regime_b"]
    j = (side(stats, "a").join(F.broadcast(pairs.select(*key)), ["dataset", "model_a", "regime_a"])
         .join(side(stats, "b"), ["dataset", "model_b", "regime_b", "b"]))
    boot = F.col("b") >= 0
    aggs = []
    for m in metrics:
        va, vb = F.col(f"{m}_a"), F.col(f"{m}_b")
        aggs.append(F.struct(F.lit(m).alias("metric"),
                             F.max(F.when(~boot, va)).alias("a"), F.max(F.when(~boot, vb)).alias("b"),
                             F.avg(F.when(boot, (F.round(va - vb, TIE) <= 0).cast("double"))).alias("_below"),
                             F.avg(F.when(boot, (F.round(va - vb, TIE) >= 0).cast("double"))).alias("_above")))
    g = j.groupBy(*key).agg(F.array(*aggs).alias("_m")).select(*key, F.inline("_m"))
    out = g.select(*key, "metric", "a", "b", (F.col("a") - F.col("b")).alias("diff"),
                   F.least(F.lit(1.0), F.lit(2.0) * F.least("_below", "_above")).alias("p_value"))
    if n is not None:
        out = out.join(n, "dataset")
    return out


def significance(per_series: DataFrame, resamples: int = N_RESAMPLES, seed: int = SEED, pairs: DataFrame | None = None,
                 metrics=METRICS) -> DataFrame:
    """All pairs of cells × metrics (or the given pairs), with series count ``n``."""
    per_series = materialize(per_series.select(*CELL, "sid", "cost", "demand", "mase"))
    pos = materialize(positions(per_series))
    stats = replicate_stats(per_series, pos, Layout(resamples, seed), metrics)
    n = pos.groupBy("dataset").agg(F.max("n").alias("n"))
    return paired_tests(stats, pairs, metrics, n)
