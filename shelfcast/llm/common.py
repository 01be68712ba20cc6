"""Helpers shared by the operators: scratch tables, ASCII lower-casing, and numpy kernels that
turn an Arrow column of texts into word hashes without a Python loop per word."""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import delete_path, scratch_path

#: The word class of the query contracts: everything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made inside at the end. Gives a function that writes a frame as a table that stays
    until the scope around this one ends, if there is one."""
    own: list[str] = []
    around = _SCOPES[-1] if _SCOPES else []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = scratch_table(df, name)
        around.append(_SCOPES[-1].pop())  # the table just written
        return out
    _SCOPES.append(own)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in own:
            delete_path(spark, path)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared checkpoint folder and read it back. The
    shuffle files of the writing job go with its end; a lost executor costs a read, no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``table`` (written, so that counting costs nothing) marked for broadcast if its rows are ``most`` bytes at most; a
    larger one is left to the planner, which shuffles."""
    return F.broadcast(table) if table.count() * row_bytes <= most else table


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix64(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    z = z.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each text's first word, n + 1 long); words end where texts end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, index of each text's first word)."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lens = ends - starts
    at = np.cumsum(lens) - lens
    inside = np.arange(lens.sum()) - np.repeat(at, lens)
    chars = _BYTE[_LOWER[data[np.repeat(starts, lens) + inside]]]
    sums = np.add.reduceat(chars * powers(int(lens.max()))[inside], at)
    return mix64(sums + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first


def text_chunks(data: np.ndarray, offs: np.ndarray, most: int = 1 << 20):
    """Ranges (i, j) of texts of about ``most`` bytes together (a longer text is a range of its own),
    so that the kernels' temporary arrays stay small."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j
