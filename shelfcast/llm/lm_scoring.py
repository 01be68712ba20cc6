"""Language-model scoring by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of all orders and a uniform one, with
weights that depend on how often its context was seen (buckets by powers of two). Part of the training
documents is held out: n-grams are counted on the rest, and expectation-maximisation finds the weights
under which the held-out counts are likeliest; the final estimates use all training documents. Counts
are exact and live in buckets of n-gram keys; runs of documents ask for those that they need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, scratch_table, text_bytes, text_chunks, word_hashes
from .runs import Runs, answers_of, ask, packed, unpacked_counts

_BEGIN, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 40  # of context counts, by powers of two


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens, n + 1 offsets of texts): the words of each text, then its end."""
    words, first = word_hashes(data, offs)
    n = len(offs) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    end = np.zeros(len(out), bool)
    end[at[1:] - 1] = True
    out[~end], out[end] = words, _END
    return out, at


def gram_keys(toks: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[k - 1]: the key of the k-gram that ends at each token; before a text's first token stand
    begin marks. keys[k - 1] of the context of a token is the key of the k-gram that ends just before."""
    pos = np.arange(len(toks)) - np.repeat(at[:-1], np.diff(at))
    keys, h = [toks], toks
    for k in range(2, order + 1):
        back = np.full(len(toks), _BEGIN)
        back[k - 1:] = toks[:len(toks) - k + 1]
        back[pos < k - 1] = _BEGIN
        h = mix64(h * _STEP + back + np.uint64(k))
        keys.append(h)
    return keys


def begin_key(k: int) -> np.ndarray:
    """The key of k begin marks, the context of a text's first token."""
    h = np.array([_BEGIN])
    for j in range(2, k + 1):
        h = mix64(h * _STEP + _BEGIN + np.uint64(j))
    return h


class Model:
    """order, n_tokens, n_types and weights: (order - 1, BUCKETS, 2) shares of the estimate of an order against
    what lies below it, and the share of the unigram estimate against the uniform one."""

    def __init__(self, order, n_tokens, n_types, weights):
        self.order, self.n_tokens, self.n_types, self.weights = order, n_tokens, n_types, weights


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two."""
    return np.minimum(np.frexp(count.astype(float))[1], BUCKETS - 1)


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
                    held_out_share: float = 0.125, rounds: int = 20, close: float = 1e-4) -> DataFrame:
    """id, held_out (not ``train``), n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``train`` marks the rows that are learned from; a null mark counts as not. A null text is empty: its only
    token is the end. Repeated rows are counted and scored one by one. Without training rows all estimates but
    the uniform one are 0. No rows give no rows; other columns are not read. Ties do not occur."""
    # the held-out part of the training rows, by a hash of the row; 0: scored only, 1: counted, 2: held out
    held = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col), F.lit("em")), F.lit(1 << 20)) < int(held_out_share * (1 << 20))
    part = F.when(~F.coalesce(train, F.lit(False)), 0).when(held, 2).otherwise(1).cast("int")
    runs = Runs(docs, id_col, text_col, {"part": part})

    def grams(t: pa.Table):
        data, offs = text_bytes(t.column("text"))
        found = [tokens(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in text_chunks(data, offs)]
        toks = np.concatenate([f[0] for f in found])
        lens = np.concatenate([np.diff(f[1]) for f in found])
        at = np.concatenate([[0], np.cumsum(lens)])
        return toks, at, gram_keys(toks, at, order)

    def keys_of(t: pa.Table):
        toks, at, keys = grams(t)
        kinds = np.asarray(t.column("part").to_numpy())
        kind = np.repeat(kinds, np.diff(at))
        out = {}
        for k in range(1, order + 1):
            own, parts = keys[k - 1], kind
            if k < order:  # contexts of begin marks: as many as texts
                own, parts = np.concatenate([own, np.repeat(begin_key(k), len(kinds))]), np.concatenate([kind, kinds])
            u, index = np.unique(own, return_inverse=True)
            out[k] = u, {"counted": np.bincount(index[parts == 1], minlength=len(u)), "held": np.bincount(index[parts == 2], minlength=len(u))}
        return out

    def merge(sums):
        return {"counted": sums["counted"], "all": sums["counted"] + sums["held"]}

    answers = ask(runs, keys_of, ("counted", "held"), merge, ("counted", "all"),
                  runs.buckets(0.17 * order), "lm_counts")

    def totals(batches):
        for b in batches:
            for c, x in zip(unpacked_counts(b.column(0)), unpacked_counts(b.column(1))):
                yield pa.RecordBatch.from_pydict({"nc": c[:1], "vc": c[1:], "na": x[:1], "va": x[1:]})
    sums = (answers.filter("run = -1 and kind = 1").select("counted", "all").mapInArrow(totals, "nc long, vc long, na long, va long")
            .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nc", "vc", "na", "va")])).first()
    sizes = runs.docs.agg(F.count_if(F.col("part") == 1).alias("c"), F.count_if(F.col("part") > 0).alias("a")).first()
    # begin marks were asked for as unigrams so that they can be contexts; they are no tokens
    begins = order > 1
    n_counted, v_counted = sums["nc"] - begins * sizes["c"], sums["vc"] - (begins and sizes["c"] > 0)
    n_all, v_all = sums["na"] - begins * sizes["a"], sums["va"] - (begins and sizes["a"] > 0)

    def looked_up(t: pa.Table, a: pa.Table, column: str):
        """(token offsets, counts of the k-gram that ends at each token, counts of its context for k > 1)."""
        toks, at, keys = grams(t)
        counts, contexts, tables = [], [], []
        for k in range(1, order + 1):
            own = np.concatenate([keys[k - 1], begin_key(k)]) if k < order else keys[k - 1]
            u, index = np.unique(own, return_inverse=True)
            values = answers_of(a, k, column)
            tables.append((u, values))
            counts.append(values[index[:len(toks)]])
        starts = at[:-1]
        for k in range(2, order + 1):
            c = np.empty(len(toks), np.int64)
            c[1:] = counts[k - 2][:-1]
            u, values = tables[k - 2]
            c[starts] = values[np.searchsorted(u, begin_key(k - 1)[0])]
            contexts.append(c)
        return at, counts, contexts

    def estimates(counts, contexts, n):
        """Maximum-likelihood estimates, unigram first."""
        out = [counts[0] / max(n, 1)]
        for c, ctx in zip(counts[1:], contexts):
            out.append(c / np.maximum(ctx, 1))
        return out

    def events(t: pa.Table, a: pa.Table) -> pa.Table:
        """Of the held-out documents: each token's estimates and context bucket (of the longest context)."""
        at, counts, contexts = looked_up(t, a, "counted")
        kind = np.repeat(np.asarray(t.column("part").to_numpy()), np.diff(at))
        on = kind == 2
        p = estimates(counts, contexts, n_counted)
        b = bucket(contexts[-1]) if contexts else np.zeros(len(kind), np.int64)
        return pa.table({"b": pa.array([packed(b[on].astype(np.uint8))], pa.binary()), "p": pa.array([b"".join(x[on].astype(np.float32).tobytes() for x in p)], pa.binary())})

    seen = scratch_table(runs.apply_with(answers.filter("run >= 0"), events, "b binary, p binary"), "lm_held_out")
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    uniform = 1 / (v_counted + 1)
    for _ in range(rounds):
        def expect(batches, w=weights):
            total = np.zeros((BUCKETS, order + 1))
            for batch in batches:
                for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    b = np.frombuffer(x, np.uint8).astype(np.int64)
                    if not len(b):
                        continue
                    p = np.frombuffer(y, np.float32).reshape(order, -1)
                    share = [np.full(len(b), uniform) * w[b, 0], *[p[k] * w[b, k + 1] for k in range(order)]]
                    whole = np.maximum(sum(share), 1e-300)
                    for k in range(order + 1):
                        total[:, k] += np.bincount(b, share[k] / whole, BUCKETS)
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "x": total.ravel()})
        got = seen.mapInArrow(expect, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # BUCKETS x (order + 1) rows
        total = np.zeros(weights.size)
        for r in got:
            total[r["i"]] = r["x"]
        total = total.reshape(weights.shape)
        # a little of each component, so that a bucket without held-out tokens and unseen words keep some mass
        new = (total + 1e-3) / (total + 1e-3).sum(1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved < close:
            break

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, [t.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})
        at, counts, contexts = looked_up(t, a, "all")
        p = estimates(counts, contexts, n_all)
        b = bucket(contexts[-1]) if contexts else np.zeros(len(p[0]), np.int64)
        mixed = weights[b, 0] / (v_all + 1)
        for k in range(order):
            mixed = mixed + weights[b, k + 1] * p[k]
        base = np.log10((counts[0] + 1) / (n_all + v_all + 1))
        cut = at[:-1]
        return pa.table({"id": t.column("id"), "part": t.column("part"), "n_tokens": pa.array(np.diff(at).astype(np.int64)),
                         "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), cut)),
                         "base_score": pa.array(np.add.reduceat(base, cut)), "score": pa.array(np.add.reduceat(np.log10(mixed), cut))})

    names = ["id", "part", "n_tokens", "n_known", "base_score", "score"]
    out = runs.apply_with(answers.filter("run >= 0"), score,
                          f"id {runs.id_type}, part int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known",
                      F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
