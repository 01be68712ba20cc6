"""Language identification with interpolated Kneser-Ney character models.

One model of order ``order`` per language over letters (other characters become one space). The
n-grams of all orders lie in one array of sorted 64-bit hashes, each with a row of log probabilities
and back-off weights per language. A text gets the language of least cross-entropy per character;
``score`` is the calibrated probability of that language, and ``rejected`` marks texts whose
cross-entropy lies beyond nearly all training texts of the language."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

SPACE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1B54A32D192ED03)
_CHAR = mix64(np.arange(1 << 16, dtype=np.uint64) + _STEP)
MEMO = 20  # bits of a worker's table of look-ups made before


def letters(col) -> tuple[np.ndarray, np.ndarray]:
    """(code points, n + 1 offsets) of lower-cased texts in which each run of characters that are neither
    letters nor the marks on them is one space; each text begins and ends with a space; one without a
    letter, marks or not, is just a space."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    col = pc.if_else(pc.match_substring_regex(col, r"\p{L}"), col, "")
    col = pc.replace_substring_regex(col, r"[^\p{L}\p{M}]+", " ")
    trimmed = [t.strip(" ") for t in col.to_pylist()]
    trimmed = [f" {t} " if t else " " for t in trimmed]
    n = np.fromiter(map(len, trimmed), np.int64, len(trimmed))
    text = "".join(trimmed)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.concatenate([[0], np.cumsum(n)])


def gram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order: the hash of the k characters that end at each position (wrong where a text
    begins less than k before; callers mask those). A gram's hash is that of its context times the base
    plus its last character's."""
    last = _CHAR[chars] if len(chars) and chars.max() < len(_CHAR) else mix64(chars.astype(np.uint64) + _STEP)
    out = [last]
    for _ in range(1, order):
        h = last.copy()
        h[1:] += out[-1][:-1] * _BASE
        out.append(h)
    return out


def count_grams(order: int):
    """mapInArrow over (lang, text): (lang, k, gram, left, n) partial counts; left is the hash of the gram
    without its first character, ctx that of the gram without its last."""
    def run(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                chars, offs = letters(pa.array([t for t, x in zip(b.column(1).to_pylist(), langs) if x == lang], pa.large_string()))
                pos = np.arange(len(chars)) - np.repeat(offs[:-1], np.diff(offs))
                grams = gram_hashes(chars, order)
                for k in range(1, order + 1):
                    ok = pos >= max(k - 1, 1)  # the first space is context only
                    at = np.flatnonzero(ok)
                    g = grams[k - 1][at]
                    u, first, n = np.unique(g, return_index=True, return_counts=True)
                    where = at[first]
                    left = grams[k - 2][where] if k > 1 else np.zeros(len(u), np.uint64)
                    ctx = grams[k - 2][where - 1] if k > 1 else np.zeros(len(u), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), k, np.int32)),
                         pa.array(u.view(np.int64)), pa.array(left.view(np.int64)), pa.array(ctx.view(np.int64)),
                         pa.array(n.astype(np.int64))], ["lang", "k", "gram", "left", "ctx", "n"])
    return run


def kneser_ney(counts: pd.DataFrame, order: int, discount: float = 0.75) -> dict:
    """The model's arrays from (lang, k, gram, left, ctx, n): sorted hashes per order, log10 probability and
    log10 back-off weight per language. The top order uses counts, lower orders numbers of distinct
    characters on the left; the lowest is mixed with a uniform distribution."""
    langs = sorted(counts["lang"].unique())
    model: dict = {"order": order, "langs": langs, "grams": [], "logp": [], "ctx": [], "bow": []}
    tables = {k: np.unique(counts.loc[counts["k"] == k, "gram"].to_numpy().view(np.uint64)) for k in range(1, order + 1)}
    for k in range(1, order + 1):
        model["grams"].append(tables[k])
        model["logp"].append(np.full((len(tables[k]), len(langs)), np.nan, np.float32))
        model["bow"].append(np.zeros((len(tables[k]), len(langs)), np.float32))
    n_chars = max(len(tables[1]), 1)
    model["floor"] = float(np.log10(1 / (n_chars + 1)))
    model["bow0"] = np.zeros(len(langs), np.float32)
    for col, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        lower: dict[int, float] = {}
        for k in range(1, order + 1):
            rows = own[own["k"] == k].copy()
            if k < order:
                above = own[own["k"] == k + 1].groupby("left").size()
                rows["c"] = rows["gram"].map(above).fillna(0) + 0.0
                # a gram seen only where a text begins has no character on its left: it counts once
                rows["c"] = rows["c"].where(rows["c"] > 0, 1.0)
            else:
                rows["c"] = rows["n"].astype(float)
            ctx = rows.groupby("ctx")["c"].agg(["sum", "size"])
            total, kinds = rows["ctx"].map(ctx["sum"]), rows["ctx"].map(ctx["size"])
            below = rows["left"].map(lower) if k > 1 else 1 / (n_chars + 1)
            p = (rows["c"] - discount) / total + discount * kinds / total * below
            at = np.searchsorted(tables[k], rows["gram"].to_numpy().view(np.uint64))
            model["logp"][k - 1][at, col] = np.log10(p.to_numpy(float))
            weight = np.log10(discount * ctx["size"] / ctx["sum"])
            if k == 1:
                model["bow0"][col] = weight.iloc[0]
            else:
                keys = weight.index.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(tables[k - 1], keys), len(tables[k - 1]) - 1)
                ok = tables[k - 1][at] == keys  # a context of the opening space alone may be no gram itself
                model["bow"][k - 2][at[ok], col] = weight.to_numpy()[ok]
            lower = dict(zip(rows["gram"], p))
    return model


def log_probs(model: dict, grams: list[np.ndarray], prev: list[np.ndarray], longest: np.ndarray) -> np.ndarray:
    """(n, languages) log10 probabilities: ``grams[k-1]`` end at a position, ``prev[k-1]`` just before it,
    ``longest`` is the longest gram that lies within the text."""
    n = len(longest)
    out = np.full((n, len(model["langs"])), model["floor"], np.float32) + model["bow0"]
    for k in range(1, model["order"] + 1):
        table = model["grams"][k - 1]
        if not len(table):
            continue
        at = np.minimum(np.searchsorted(table, grams[k - 1]), len(table) - 1)
        seen = (table[at] == grams[k - 1]) & (longest >= k)
        p = np.where(seen[:, None], model["logp"][k - 1][at], np.nan)
        if k > 1:
            lower = model["grams"][k - 2]
            c = np.minimum(np.searchsorted(lower, prev[k - 2]), len(lower) - 1)
            known = (lower[c] == prev[k - 2]) & (longest >= k)
            out += np.where(known[:, None], model["bow"][k - 2][c], 0)
        out = np.where(np.isnan(p), out, p)
    return out


class Memo:
    """Look-ups made before, by hash of the longest gram: an entry is replaced by the next that falls on
    its place, so the table is bounded and only ever saves work."""

    def __init__(self, langs: int):
        self.keys = np.zeros(1 << MEMO, np.uint64)
        self.rows = np.zeros((1 << MEMO, langs), np.float32)


def entropies(model: dict, col, memo: Memo | None = None, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(bits per character of each text under each language, number of characters scored)."""
    memo = memo or Memo(len(model["langs"]))
    chars, offs = letters(col)
    order, langs = model["order"], len(model["langs"])
    total = np.zeros((len(offs) - 1, langs))
    n = np.maximum(np.diff(offs) - 1, 0)
    for a in range(0, len(chars), chunk):
        b, back = min(a + chunk, len(chars)), max(0, a - order)
        hashed = gram_hashes(chars[back:b], order)
        doc = np.searchsorted(offs, [a, b - 1], "right") - 1
        docs = np.arange(doc[0], doc[1] + 1)
        starts = np.maximum(offs[docs], a)
        pos = np.arange(a, b) - np.repeat(offs[docs], np.diff(np.append(starts, b)))
        at = np.flatnonzero(pos >= 1)  # the opening space is context only
        if not len(at):
            continue
        longest = np.minimum(pos[at] + 1, order)
        here = at + a - back
        key = hashed[order - 1][here]
        place = (key * _STEP) >> np.uint64(64 - MEMO)
        new = (memo.keys[place] != key) | (longest < order)
        lp = memo.rows[place]
        if new.any():
            spot = here[new]
            rows = log_probs(model, [h[spot] for h in hashed], [h[spot - 1] for h in hashed], longest[new])
            lp[new] = rows
            whole = np.flatnonzero(longest[new] == order)
            # the last of several grams on one place stays, key and row alike
            p, last = np.unique(place[new][whole][::-1], return_index=True)
            pick = whole[::-1][last]
            memo.keys[p], memo.rows[p] = key[new][pick], rows[pick]
        owner = np.searchsorted(starts, a + at, "right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[docs[owner[cuts]]] += np.add.reduceat(lp, cuts, axis=0, dtype=float)
    return -total / np.log10(2) / np.maximum(n, 1)[:, None], n


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5,
          sample: int = 600, reject: float = 0.995) -> dict:
    """Fit on about ``sample`` whole texts of each language, chosen by a hash of the id (the documented
    bound on the model's data); calibrate temperature and rejection limits on another sample of that size."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.col(id_col).cast("string").alias("id"))
    sizes = rows.groupBy("lang").count()
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(sizes), "lang").withColumn("u", draw * F.col("count")).filter(F.col("u") < 2 * sample)
    counted = (picked.filter(F.col("u") < sample).select("lang", "text")
               .mapInArrow(count_grams(order), "lang string, k int, gram long, left long, ctx long, n long")
               .groupBy("lang", "k", "gram", "left", "ctx").agg(F.sum("n").alias("n")))
    counts = counted.toPandas()  # bounded by ``sample`` texts a language
    if not len(counts):
        return {"order": order, "langs": []}
    model = kneser_ney(counts, order)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    langs = model["langs"]

    def score(batches):
        for b in batches:
            h, n = entropies(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h.tolist(), pa.list_(pa.float64()))], ["lang", "n", "h"])
    held = picked.filter(F.col("u") >= sample).select("lang", "text").mapInArrow(score, "lang string, n long, h array<double>").toPandas()
    held = held[held["n"] > 0]
    h = np.array(held["h"].tolist()).reshape(len(held), len(langs))
    true = np.array([langs.index(x) if x in langs else 0 for x in held["lang"]], int)
    # temperature: the scale of entropy differences under which the held-out labels are likeliest
    best, model["scale"] = np.inf, 1.0
    for scale in np.geomspace(0.25, 64, 33):
        z = -h * scale
        loss = (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), true]).mean() if len(z) else np.inf
        if loss < best:
            best, model["scale"] = loss, float(scale)
    own = h[np.arange(len(h)), true]
    model["limit"] = np.array([np.quantile(own[true == j], reject) if (true == j).any() else np.inf for j in range(len(langs))])
    return model


def predict(docs: DataFrame, model: dict, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",),
            keep: tuple[Column, ...] = ()) -> DataFrame:
    """<id_cols>, ``keep``, lang_pred, score, rejected, n_letters: for every whole text the language of least
    cross-entropy (the first by name on ties). A text that is null or has no letter is ``und`` with score 0;
    without any trained language all texts are ``und``. Repeated rows are predicted alike; no rows give no rows."""
    rows = docs.select(*id_cols, *keep, F.col(text_col).alias("__text"))
    kept = rows.drop("__text").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in kept] + ["lang_pred", "score", "rejected", "n_letters"]

    def run(batches):
        m = shared.value
        memo = Memo(max(len(m["langs"]), 1))
        langs = np.array([*m["langs"], "und"], object)
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                b = whole.slice(start, 128)
                size = b.num_rows
                if len(langs) > 1:
                    h, n = entropies(m, b.column(len(kept)), memo)
                    z = np.exp(-(h - h.min(1, keepdims=True)) * m["scale"])
                    best = h.argmin(1)
                    score, far = z.max(1) / z.sum(1), h.min(1) > m["limit"][best]
                else:
                    n, best, score, far = np.zeros(size, np.int64), np.zeros(size, int), np.zeros(size), np.zeros(size, bool)
                none = n == 0
                pred = langs[np.where(none, len(langs) - 1, best)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(kept))), pa.array(pred.tolist(), pa.string()),
                     pa.array(np.where(none, 0.0, score)), pa.array(far | none), pa.array(n.astype(np.int64))], names)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean, n_letters long")
