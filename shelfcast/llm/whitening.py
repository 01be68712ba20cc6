"""Embedding whitening by shifted Cholesky QR.

Each usable vector becomes whole numbers x = floor(1024 c) + 100000. One pass counts them and sums each
dimension exactly. The rows A = x - S/n are then orthogonalised by Gram passes: a pass adds up G = Q'Q of the rows
Q = A R^-1 so far, factors G = L L', and multiplies R by L' on the left. The first factor is that of G + s I,
with a shift s above the rounding error of G, so that it exists for badly conditioned rows too; each further pass
squares the distance to orthogonal rows away. A = Q R with orthogonal Q in the end, so the singular values and right
vectors of the d x d matrix R are those of A: the components.

A pass holds a batch of rows and a d x d matrix; Spark adds up the matrices' entries, and d * d sums come to the driver,
however many rows there are. Rows are read again in every pass, so a lost executor costs its share of one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**52  # of |x|; beyond it a double holds no fraction to floor
UNIT = 2.0**-53  # rounding unit of a double
ROWS = 4096  # of a block


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]      # S, per dimension
    vectors: np.ndarray        # k x d, a unit eigenvector a row, by falling eigenvalue
    values: np.ndarray         # k eigenvalues of the covariance with divisor n
    trace: float
    identity_error: float


def whole_vectors(col: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are used, their x as longs) of a column of lists. Rows that are null, hold a null, a not finite
    entry or one too large to floor, or do not have ``dims`` entries (None: as many as the first usable row) are not."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), -1))
    flat = col.flatten()
    c = np.asarray(pa.compute.fill_null(flat.cast(pa.float64()), np.nan), np.float64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    c = np.where(np.abs(c) * SCALE <= LARGEST, c, np.nan)  # false for nan and the infinities too
    bad = np.concatenate([[0], np.cumsum(np.isnan(c))])
    good = (sizes >= 0) & (bad[starts + np.maximum(sizes, 0)] == bad[starts])
    if dims is None:
        return np.flatnonzero(good), sizes[good]
    rows = np.flatnonzero(good & (sizes == dims))
    at = starts[rows][:, None] + np.arange(dims)
    return rows, np.floor(c[at] * SCALE).astype(np.int64) + OFFSET if len(rows) and dims else np.zeros((len(rows), dims), np.int64)


def dimensions(vectors: DataFrame) -> int:
    """The most frequent length of a usable vector (ties: the longer)."""
    def run(batches):
        for b in batches:
            lens, n = np.unique(whole_vectors(b.column(0), None)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"dims": pa.array(lens, pa.int64()), "n": pa.array(n, pa.int64())})
    found = (vectors.mapInArrow(run, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), F.desc("dims")).first())
    return int(found["dims"]) if found else 0


def exact_sums(vectors: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """(n, exact sum of x per dimension)."""
    def run(batches):
        n, s = 0, [0] * dims
        for b in batches:
            x = whole_vectors(b.column(0), dims)[1]
            # halves of 32 bits add up without overflow, whatever the values
            n, s = n + len(x), [t + (int(h) << 32) + int(w) for t, h, w in zip(s, (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, dims), pa.int32()),
                                          "s": pa.array([Decimal(v) for v in (n, *s)], pa.decimal128(38, 0))})
    got = {r["i"]: int(r["s"]) for r in
           vectors.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(-1, 0), tuple(got.get(i, 0) for i in range(dims))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly, then its fraction."""
    q, r = zip(*(divmod(s, n) for s in sums)) if sums else ((), ())
    return (x - np.array(q, np.int64)).astype(np.float64) - np.array(r, np.float64) / n


def _rows(batches: Iterator[pa.RecordBatch], n: int, sums: tuple[int, ...]) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            x = whole_vectors(b.column(0).slice(k, ROWS), len(sums))[1]
            if len(x):
                yield centred(x, n, sums)


def projected_sums(vectors: DataFrame, n: int, sums: tuple[int, ...], project: np.ndarray) -> np.ndarray:
    """Sum over all rows of A P."""
    k = project.shape[1]

    def run(batches):
        total = np.zeros(k)
        for a in _rows(batches, n, sums):
            total += (a @ project).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()), "s": pa.array(total)})
    got = vectors.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k)
    for r in got:
        out[r["i"]] = r["s"]
    return out


def gram(vectors: DataFrame, n: int, sums: tuple[int, ...], project: np.ndarray, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """Q'Q over all rows for Q = A P - mean."""
    k = project.shape[1]
    i, j = np.triu_indices(k)

    def run(batches):
        g = np.zeros((k, k))
        for a in _rows(batches, n, sums):
            q = a @ project - mean
            g += q.T @ q
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "g": pa.array(g[i, j])})
    out = np.zeros((k, k))
    for r in vectors.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def upper_factor(g: np.ndarray, shift: float = 0.0) -> np.ndarray | None:
    """R with R'R = G + shift I, None if there is none."""
    try:
        return np.linalg.cholesky(g + shift * np.eye(len(g))).T
    except np.linalg.LinAlgError:
        return None


def shifted_cholesky_qr(vectors: DataFrame, n: int, sums: tuple[int, ...], passes: int = 3) -> np.ndarray:
    """R with A'A = R'R. Where rows do not span all dimensions the last Gram matrix may have no Cholesky factor; its
    square root takes that place, so that R'R stays A'A."""
    d = len(sums)
    chain = ROWS + n / ROWS  # additions one after the other: within a block, then of blocks
    r = np.eye(d)
    for k in range(passes):
        g = gram(vectors, n, sums, np.linalg.solve(r, np.eye(d)))
        # the trace bounds the squared norm of Q
        shift = 11 * (chain * d + d * (d + 1)) * UNIT * float(np.trace(g)) or 1.0
        factor = upper_factor(g, 0.0 if k else shift)
        if factor is None and k < passes - 1:
            factor = upper_factor(g, shift)
        if factor is None:
            values, v = np.linalg.eigh(g)
            factor = np.sqrt(np.maximum(values, 0))[:, None] * v.T
        r = factor @ r
    return r


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of a frame with one column of vectors; None without a usable vector. Components whose variance
    is nought as far as doubles tell have the value 0."""
    dims = dimensions(vectors)
    n, sums = exact_sums(vectors, dims)
    if not n or not dims:
        return None
    _, s, vt = np.linalg.svd(shifted_cholesky_qr(vectors, n, sums))
    s = np.where(s > s[0] * dims * 8 * UNIT, s, 0.0)
    values = s * s / n
    k = min(components, dims)
    some = values[:k] > 0
    error = 0.0
    if some.any():
        project = vt[:k][some].T / np.sqrt(values[:k][some])
        mean = projected_sums(vectors, n, sums, project) / n
        cov = gram(vectors, n, sums, project, mean) / n
        error = float(np.abs(cov - np.eye(len(cov))).max())
    return Whitening(n, sums, vt[:k], values[:k], float(values.sum()), error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of each row; None where it does not fit a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component: <id_col>, component (from 1, by falling variance), n (usable vectors),
    deviation (exact sum over dimensions of (n x - S)^2), whitened (the centred row on the component, over its
    standard deviation), explained (the component's share of the variance), identity_error (largest difference of the
    whitened rows' covariance from the identity).

    Vectors that are null, empty or hold a null, not finite or (1024 times) over 2**52 large entry are left out, and so are
    those whose length is not the most frequent one (ties: the longest). Repeated rows and ids count and come as
    often as they are there, rows without an id too. Fewer dimensions than ``components`` give that many. A component
    without variance has a null whitened and is not in identity_error; explained is null where no dimension has any
    variance; a deviation that does not fit a long is null. No usable rows give no rows. Other columns are not read."""
    found = fit(table.select(F.col(vector_col).alias("v")), components)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()
    if found is None:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(1).alias("component"), *[
            F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"),
                                                      ("explained", "double"), ("identity_error", "double"))])
    k, some = len(found.values), found.values > 0
    project = found.vectors.T / np.sqrt(np.where(some, found.values, np.inf))
    explained = found.values / found.trace if found.trace else None

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                used, x = whole_vectors(part.column(1), len(found.sums))
                w = np.ascontiguousarray(centred(x, found.n, found.sums) @ project)
                each = np.repeat(np.arange(len(used)), k)
                hole = np.tile(~some, len(used))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(used[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(used))),
                    pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), mask=hole),
                    pa.array(np.tile(explained, len(used)) if explained is not None else [None] * len(each), pa.float64())],
                    ["id", "component", "deviation", "whitened", "explained"])
    out = rows.mapInArrow(run, f"id {id_type}, component int, deviation long, whitened double, explained double")
    return out.select(F.col("id").alias(id_col), "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                      "explained", F.lit(found.identity_error).alias("identity_error"))
