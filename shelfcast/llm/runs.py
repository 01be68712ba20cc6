"""Round trips of keys between runs of documents and buckets of keys.

Documents are dealt into runs of bounded size by a hash of their rows. Each run sends the distinct keys
it holds, one row per (run, bucket), so a hot key costs a bucket one entry per run and never one per
occurrence; a bucket merges what all runs say of its keys and answers each run in the order in which
the run sent its keys; the run, computed again from its documents, applies the answers. All three
steps see bounded groups, and any of them can be run again after a lost executor."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table

RUN_BYTES = 4 << 20
#: Keys that a bucket receives, about.
BUCKET_KEYS = 1 << 20


class Runs:
    """``docs`` as (run, id, text, ...) dealt into runs of about ``run_bytes`` of text each."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, extra: dict | None = None, run_bytes: int = RUN_BYTES):
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                           *[c.alias(k) for k, c in (extra or {}).items()])
        found = rows.agg(F.sum(F.octet_length("text") + 16).alias("b"), F.count("*").alias("n")).first()
        self.bytes, self.rows = found["b"] or 0, found["n"]
        self.count = max(1, math.ceil(self.bytes / run_bytes))
        self.docs = rows.withColumn("run", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(self.count)).cast("int"))
        self.id_type = rows.schema["id"].dataType.simpleString()

    def buckets(self, keys_per_byte: float) -> int:
        return max(1, math.ceil(self.bytes * keys_per_byte / BUCKET_KEYS))

    def apply(self, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``fn`` of each run's documents, in an order that depends on the documents alone."""
        return self.docs.groupBy("run").applyInArrow(lambda t: fn(in_order(t)), schema)

    def apply_with(self, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``fn`` of each run's documents and the answers (run, bucket, ...) to it, by bucket."""
        return self.docs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
            lambda t, a: fn(in_order(t), a.sort_by("bucket")), schema)


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()


def run_of(t: pa.Table) -> int:
    return t.column("run")[0].as_py()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key; ascending for ascending keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split_points(keys: np.ndarray, buckets: int) -> np.ndarray:
    """For sorted keys: where each bucket's keys begin, and the end."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def packed_counts(a: np.ndarray) -> bytes:
    """Counts in the least width that holds them, after a byte that names it."""
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + packed(a.astype(f"u{width}"))


def unpacked_counts(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64) for x in column.to_pylist()]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their differences' bytes: high planes are nearly all zero and compress."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return packed(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpacked_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)
            for x in column.to_pylist()]


def ask(runs: Runs, keys_of: Callable[[pa.Table], dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]], columns: tuple[str, ...],
        merge: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], answer: tuple[str, ...], buckets: int, name: str) -> DataFrame:
    """The round trip: ``keys_of`` gives a run's sorted distinct keys (and counts ``columns`` on them) by kind;
    ``merge`` gets, for one bucket, the counts summed over runs per distinct key and gives the counts
    ``answer`` per distinct key. Returns a table (run, kind, bucket, <answer> as packed counts); run -1 holds one
    row per bucket with (sum, number of keys above 0) of each answer."""
    def send(t: pa.Table) -> pa.Table:
        out = {"kind": [], "bucket": [], "run": [], "keys": [], **{c: [] for c in columns}}
        for kind, (keys, cols) in keys_of(t).items():
            cut = split_points(keys, buckets)
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                for k, v in (("kind", kind), ("bucket", int(b)), ("run", run_of(t)), ("keys", packed_keys(keys[part]))):
                    out[k].append(v)
                for c in columns:
                    out[c].append(packed_counts(cols[c][part]))
        types = {"kind": pa.int32(), "bucket": pa.int32(), "run": pa.int32()}
        return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    def meet(t: pa.Table) -> pa.Table:
        sent = unpacked_keys(t.column("keys"))
        distinct, index = np.unique(np.concatenate(sent), return_inverse=True)
        found = merge({c: np.bincount(index, np.concatenate(unpacked_counts(t.column(c))), len(distinct)).astype(np.int64) for c in columns})
        ends, n = np.cumsum([len(s) for s in sent])[:-1], len(sent)
        back = {a: [packed_counts(x) for x in np.split(found[a].astype(np.int64)[index], ends)]
                + [packed_counts(np.array([found[a].sum(), (found[a] > 0).sum()], np.int64))] for a in answer}
        return pa.table({"run": pa.array([*t.column("run").to_pylist(), -1], pa.int32()),
                         "kind": pa.array([t.column("kind")[0].as_py()] * (n + 1), pa.int32()),
                         "bucket": pa.array([t.column("bucket")[0].as_py()] * (n + 1), pa.int32()),
                         **{a: pa.array(v, pa.binary()) for a, v in back.items()}})

    sent = runs.apply(send, "kind int, bucket int, run int, keys binary" + "".join(f", {c} binary" for c in columns))
    met = sent.groupBy("kind", "bucket").applyInArrow(meet, "run int, kind int, bucket int" + "".join(f", {a} binary" for a in answer))
    return scratch_table(met, name)


def answers_of(a: pa.Table, kind: int, column: str) -> np.ndarray:
    """A run's answers of one kind in the order of its sorted keys."""
    rows = a.filter(pa.compute.equal(a.column("kind"), kind))
    return np.concatenate([np.zeros(0, np.int64), *unpacked_counts(rows.column(column))])
