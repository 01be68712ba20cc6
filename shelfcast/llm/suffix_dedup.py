"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Every ``length``-byte window has one anchor, the position in it whose ``gram``-byte string hashes least
(leftmost on ties), so equal windows have their anchors at the same place and only suffixes at anchors
need sorting. Anchors whose gram occurs once in the corpus cannot lie in a repeat and go first. Each
run of documents sorts its anchor suffixes, folds equal contexts into their first place, and sends
them front-coded (length of the prefix shared with the suffix before, then the rest), by hash of the
gram. A bucket merges its runs with a loser tree that compares two suffixes only beyond the prefix
both are known to share with the last one put out. Neighbours' common prefixes then say which windows
agree to the right of the anchor; a hash of the bytes on the left splits them, and all but the first
place of each window are repeats. A gram with more anchors than a bucket should hold is not merged: its
windows go to a plain aggregate by their hash, which gives the first place of each. Runs learn one bit per window and remove the bytes that they cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, scratch_table, text_bytes, text_chunks
from .runs import Runs, answers_of, ask, bucket_of, packed, run_of, unpacked, unpacked_counts

LENGTH, GRAM = 100, 32
_CODE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
PAD = 0xFF  # no byte of UTF-8
SLICE = 8192  # anchors whose contexts or windows are spread out at a time
RUN_BYTES = 2 << 20     # of text in a run, whose contexts are spread out in memory
BUCKET_BYTES = 6 << 20  # of text whose suffixes a bucket merges, about
HOT = 1 << 17           # anchors of one gram that a bucket merges at most
_ROWS = mix64(np.arange(1, 2 * LENGTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sliding(v: np.ndarray, width: int, step) -> np.ndarray:
    """``step`` folded over every window of ``width``, by doubling."""
    have = 1
    while 2 * have <= width:
        v = step(v[:-have], v[have:], have)
        have *= 2
    return step(v[:len(v) - (width - have)], v[width - have:], width - have) if have < width else v


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes (a power of two) from each position on."""
    p = powers(gram + 1)
    return mix64(sliding(_CODE[data], gram, lambda a, b, n: a * p[n] + b))


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(anchor, first and last window that it stands for, its gram's hash), in order of place."""
    found = []
    for i, j in text_chunks(data, offs):
        at, lo, hi, h = chunk_anchors(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], length, gram)
        found.append((at + offs[i], lo + offs[i], hi + offs[i], h))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else chunk_anchors(data, offs, length, gram)


def chunk_anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    at = sliding((h & _HIGH) | np.arange(len(h), dtype=np.uint64), length - gram + 1, lambda a, b, n: np.minimum(a, b))
    at = (at & _LOW).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that end within their text
    big = np.diff(offs) >= length
    np.add.at(inside, offs[:-1][big], 1)
    np.add.at(inside, offs[1:][big] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:len(at)] > 0)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # anchors have the least hashes of their windows: spread them again, for even buckets
    return at[first], starts[first], starts[last], mix64(h[at[first]] + _CODE[:1])


def contexts(data: np.ndarray, offs: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each anchor, a row of its suffix (``length`` bytes) and the length - gram bytes before it, nearest
    first; PAD beyond the text."""
    step = np.concatenate([np.arange(length), -np.arange(1, length - gram + 1)])
    out = np.empty((len(at), len(step)), np.uint8)
    for i in range(0, len(at), SLICE):
        part = at[i:i + SLICE]
        doc = np.searchsorted(offs, part, "right") - 1
        where = part[:, None] + step
        rows = data[np.clip(where, 0, len(data) - 1)]
        rows[(where < offs[doc][:, None]) | (where >= offs[doc + 1][:, None])] = PAD
        out[i:i + SLICE] = rows
    return out


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the window at each start."""
    factors = _ROWS if length <= LENGTH else mix64(np.arange(1, 2 * length + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out = np.empty((2, len(starts)), np.uint64)
    for i in range(0, len(starts), SLICE):
        codes = _CODE[data[starts[i:i + SLICE, None] + np.arange(length)]]
        for k in (0, 1):
            out[k, i:i + SLICE] = mix64((mix64(codes + factors[k::2][:length]) * (factors[k::2][:length] | np.uint64(1))).sum(1, dtype=np.uint64))
    return out


def all_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo..hi."""
    n = hi - lo + 1
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Suffixes:
    """A run's suffixes at anchors whose gram is frequent, but not hot (``hot``: first and last windows of those): one row per distinct context, by bucket and then
    sorted; ``copy_of`` gives each surviving anchor's row, ``lead`` each row's first anchor."""

    def __init__(self, t: pa.Table, a: pa.Table, length: int, gram: int, buckets: int):
        self.data, self.offs = text_bytes(t.column("text"))
        at, lo, hi, h = anchors(self.data, self.offs, length, gram)
        u, index = np.unique(h, return_inverse=True)
        answer = answers_of(a, 0, "often")[index]
        often = answer == 1
        self.hot = lo[answer > 1], hi[answer > 1]
        self.at, self.lo, self.hi = at[often], lo[often], hi[often]
        rows = contexts(self.data, self.offs, self.at, length, gram)
        width = rows.shape[1]
        bucket = bucket_of(h[often], buckets)
        keyed = np.concatenate([bucket.astype(">u4")[:, None].view(np.uint8).reshape(-1, 4), rows], axis=1)
        # rows come in order of place, so the first of equal rows is the earliest
        _, self.lead, self.copy_of = np.unique(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), return_index=True, return_inverse=True)
        self.rows, self.bucket = rows[self.lead], bucket[self.lead]
        self.cut = np.searchsorted(self.bucket, np.arange(buckets + 1))


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(length of the prefix shared with the row before, all rests one after the other)."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        shared[1:] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def decoded(shared: np.ndarray, rest: bytes, length: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for n in shared.tolist():
        end = at + length - n
        last = last[:n] + rest[at:end]
        out.append(last)
        at = end
    return out


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length, of which ``known`` bytes need no look."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (x.bit_length() + 7) // 8


def loser_tree(runs: list[tuple[list[int], list[bytes]]], length: int):
    """Merge sorted runs (shared prefixes, strings): yields (run, prefix shared with the one before). Every
    string still in play carries the length of its prefix in common with the last winner it met; where
    two lengths differ, the longer one is the smaller string, and no byte is looked at."""
    k = 1 << max(len(runs) - 1, 0).bit_length()
    shared = [r[0] for r in runs] + [[]] * (k - len(runs))
    strings = [r[1] for r in runs] + [[]] * (k - len(runs))
    place, now, lcp = [0] * k, [s[0] if s else None for s in strings], [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a wins; the loser's length becomes that of its prefix in common with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return True
        if x is None:
            return False
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        n = common(x, y, lcp[a])
        if n == length or x[n] < y[n]:
            lcp[b] = n
            return True
        lcp[a] = n
        return False

    best = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    w = best[1] if k > 1 else 0
    while now[w] is not None:
        yield w, lcp[w]
        place[w] += 1
        if place[w] < len(strings[w]):
            now[w], lcp[w] = strings[w][place[w]], shared[w][place[w]]
        else:
            now[w] = None
        node = (w + k) >> 1
        while node:
            if not beats(w, losers[node]):
                w, losers[node] = losers[node], w
            node >>= 1


def repeats(lcp: np.ndarray, left: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """bits[i, d]: whether the window that begins d bytes before suffix i has an earlier place. Suffixes are
    sorted, ``rank`` is their order of place; d runs over dlo..dhi of each."""
    n, most = left.shape
    out = np.zeros((n, most + 1), bool)
    by_place = np.argsort(rank)
    h = np.zeros(n, np.uint64)
    step = mix64(np.arange(1, 2, dtype=np.uint64))[0] | np.uint64(1)
    for d in range(most + 1):
        if d:
            h = h * step + _CODE[left[:, d - 1]]
        rows = by_place[(dlo[by_place] <= d) & (d <= dhi[by_place])]
        if len(rows) < 2:
            continue
        right = np.cumsum(lcp < length - d).astype(np.uint64)  # suffixes that agree on the window's bytes from the anchor on
        key = mix64(right) + h
        _, first = np.unique(key[rows], return_index=True)
        out[rows, d] = True
        out[rows[first], d] = False
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """<id_col>, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain, with ``keep_bytes``)
    for every row of ``docs``: each byte goes that is covered by a ``length``-byte string of the UTF-8 text which
    also starts earlier (smaller id, or same document and earlier start), judged on the input.

    A null text is empty; texts below ``length`` bytes lose nothing. Ids are integers; a null id counts as the
    largest; rows that repeat an id are told apart by text length and order. No rows give no rows; other
    columns are not read."""
    runs = Runs(docs, id_col, text_col, run_bytes=RUN_BYTES)
    buckets = runs.bytes // BUCKET_BYTES + 1

    def keys_of(t: pa.Table):
        data, offs = text_bytes(t.column("text"))
        u, n = np.unique(anchors(data, offs, length, gram)[3], return_counts=True)
        return {0: (u, {"n": n})}

    often = ask(runs, keys_of, ("n",), lambda sums: {"often": (sums["n"] > 1).astype(np.int64) + (sums["n"] > hot)}, ("often",),
                runs.buckets(0.03), "anchor_grams")
    asked = often.filter("run >= 0")

    def place_of(t: pa.Table, offs: np.ndarray, at: np.ndarray):
        """(id, offset within the text) of places, comparable between runs."""
        ids = np.asarray(t.column("id").cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy())
        doc = np.searchsorted(offs, at, "right") - 1
        return ids[doc], at - offs[doc]

    def count_hot(batches):
        for x in batches:  # of each bucket: sum of answers (2 for a hot gram), number of answers above 0
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(v[0] - v[1]) for v in unpacked_counts(x.column("often"))], pa.int64())})

    def send_hot(t: pa.Table, a: pa.Table) -> pa.Table:
        data, offs = text_bytes(t.column("text"))
        _, lo, hi, h = anchors(data, offs, length, gram)
        answer = answers_of(a, 0, "often")[np.unique(h, return_inverse=True)[1]] if len(h) else np.zeros(0, np.int64)
        starts = np.sort(all_of(lo[answer > 1], hi[answer > 1]))  # in order of place
        k = window_hashes(data, starts, length)
        by = np.lexsort((k[1], k[0]))  # stable: of equal windows the earliest comes first
        new = np.ones(len(by), bool)
        new[1:] = (k[:, by[1:]] != k[:, by[:-1]]).any(0)
        first = by[new]
        ids, pos = place_of(t, offs, starts[first])
        return pa.table({"k1": pa.array(k[0, first].view(np.int64)), "k2": pa.array(k[1, first].view(np.int64)),
                         "id": pa.array(ids, pa.int64()), "pos": pa.array(pos, pa.int64()),
                         "run": pa.array(np.full(len(first), run_of(t) if len(first) else 0), pa.int32()), "start": pa.array(starts[first], pa.int32())})

    def send(t: pa.Table, a: pa.Table) -> pa.Table:
        s = Suffixes(t, a, length, gram, buckets)
        ids, pos = place_of(t, s.offs, s.at[s.lead])
        dlo, dhi = s.at[s.lead] - s.hi[s.lead], s.at[s.lead] - s.lo[s.lead]
        out: dict[str, list] = {k: [] for k in ("bucket", "run", "shared", "rest", "left", "ids", "pos", "d")}
        for b in np.flatnonzero(np.diff(s.cut)):
            part = slice(s.cut[b], s.cut[b + 1])
            shared, rest = front_coded(s.rows[part, :length])
            for k, v in (("bucket", int(b)), ("run", run_of(t)), ("shared", packed(shared)), ("rest", rest), ("left", packed(s.rows[part, length:])),
                         ("ids", packed(ids[part])), ("pos", packed(pos[part].astype(np.int64))),
                         ("d", packed(np.stack([dlo[part], dhi[part]]).astype(np.uint8)))):
                out[k].append(v)
        types = {"bucket": pa.int32(), "run": pa.int32()}
        return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    def meet(t: pa.Table) -> pa.Table:
        shared = unpacked(t.column("shared"), np.uint8)
        rests = t.column("rest").to_pylist()
        order, lcp = [], []
        nth = [0] * len(shared)
        first = np.concatenate([[0], np.cumsum([len(x) for x in shared])])
        for r, n in loser_tree([(x.tolist(), decoded(x, rest, length)) for x, rest in zip(shared, rests)], length):
            order.append(int(first[r]) + nth[r])
            lcp.append(n)
            nth[r] += 1
        order = np.array(order)
        left = np.concatenate([x.reshape(-1, length - gram) for x in unpacked(t.column("left"), np.uint8)])
        ids, pos = np.concatenate(unpacked(t.column("ids"), np.int64)), np.concatenate(unpacked(t.column("pos"), np.int64))
        d = np.concatenate([x.reshape(2, -1) for x in unpacked(t.column("d"), np.uint8)], axis=1)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((pos, ids))] = np.arange(len(ids))
        bits = np.empty((len(ids), length - gram + 1), bool)
        bits[order] = repeats(np.array(lcp), left[order], d[0][order], d[1][order], rank[order], length)
        return pa.table({"run": t.column("run"), "bucket": t.column("bucket"),
                         "bits": pa.array([packed(np.packbits(x, axis=1)) for x in np.split(bits, first[1:-1])], pa.binary())})

    met = runs.apply_with(asked, send, "bucket int, run int, shared binary, rest binary, left binary, ids binary, pos binary, d binary")
    met = scratch_table(met.groupBy("bucket").applyInArrow(meet, "run int, bucket int, bits binary"), "suffix_repeats")
    # kind 0: which grams are frequent; kind 1: which windows are repeats
    both = asked.select("run", "kind", "bucket", "often", F.lit(None).cast("binary").alias("bits")).unionByName(
        met.select("run", F.lit(1).alias("kind"), "bucket", F.lit(None).cast("binary").alias("often"), "bits"))

    # kind 2: the first places of the windows of hot grams (bucket: the place in the run)
    if often.filter("run < 0").select("often").mapInArrow(count_hot, "n long").agg(F.sum("n")).first()[0]:
        windows = runs.apply_with(asked, send_hot, "k1 long, k2 long, id long, pos long, run int, start int")
        won = windows.groupBy("k1", "k2").agg(F.min(F.struct("id", "pos", "run", "start")).alias("w"))
        none = F.lit(None).cast("binary")
        both = both.unionByName(won.select(F.col("w.run").alias("run"), F.lit(2).alias("kind"), F.col("w.start").alias("bucket"),
                                           none.alias("often"), none.alias("bits")))

    def cut(t: pa.Table, a: pa.Table) -> pa.Table:
        s = Suffixes(t, a, length, gram, buckets)
        width = length - gram + 1
        flags = unpacked(a.filter(pa.compute.equal(a.column("kind"), 1)).column("bits"), np.uint8)
        bits = np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *flags]).reshape(len(s.lead), (width + 7) // 8), axis=1)[:, :width].astype(bool)
        copy = np.ones(len(s.at), bool)
        copy[s.lead] = False
        d = np.arange(width)
        start = np.zeros(len(s.data) + 1, np.int32)  # windows to remove, each of which starts at one place only
        for x in range(0, len(s.at), SLICE):
            part = slice(x, x + SLICE)
            mine = bits[s.copy_of[part]] | copy[part, None]
            mine &= (d >= (s.at - s.hi)[part, None]) & (d <= (s.at - s.lo)[part, None])
            i, back = np.nonzero(mine)
            start[s.at[part][i] - back] = 1
        start[all_of(*s.hot)] = 1
        start[a.filter(pa.compute.equal(a.column("kind"), 2)).column("bucket").to_numpy()] = 0
        edge = start
        edge[length:] -= start[:-length].copy() if len(start) > length else 0
        gone = np.cumsum(edge)[:-1] > 0
        out: dict[str, list] = {k: [] for k in ("n", "removed", "spans", "sha", "kept")}
        for x, y in zip(s.offs[:-1].tolist(), s.offs[1:].tolist()):
            g = gone[x:y]
            kept = s.data[x:y][~g].tobytes()
            out["n"].append(y - x)
            out["removed"].append(int(g.sum()))
            out["spans"].append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if y > x else 0)
            out["sha"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if keep_bytes else None)
        return pa.table({"id": t.column("id"), "n_bytes": pa.array(out["n"], pa.int64()), "n_removed": pa.array(out["removed"], pa.int64()),
                         "n_spans": pa.array(out["spans"], pa.int64()), "kept_sha256": pa.array(out["sha"], pa.string()),
                         "kept": pa.array(out["kept"], pa.binary())})

    done = runs.apply_with(both, cut, f"id {runs.id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done.withColumnRenamed("id", id_col)
    return done if keep_bytes else done.drop("kept")
