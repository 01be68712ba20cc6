"""Filter audit, toxicity and whitening against brute force, and their edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import filter_audit, toxicity, whitening

DOC = "doc_id long, text string, lang string, source string, mask string, n long, id string, good int"
LAB = "doc_id long, quality int, toxic int"


def audit_rows():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n)) for n in (10, 250, 400)]
    words = [" ".join(f"w{i}" for i in range(n)) for n in (150, 220)]
    texts = [*base, *words, words[1] + " $ A", "A B C " * 80, "X|Y", None, "", " \t\n", "lone &", "é" * 300 + " Z"]
    rows = [(i, texts[rng.randrange(len(texts))], rng.choice(["en", "de", None, ""]), "s", "m", 1, "x", 1) for i in range(160)]
    rows += [(7, "dup id", "en", "s", "m", 1, "x", 1)] * 2 + [(None, texts[0], "en", "s", "m", 1, "x", 1), (None, None, None, None, None, None, None, None)]
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 160, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)),
                                  ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                                  ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows))) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone),
                                           sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_audit_equals_replay_of_all_orders(spark):
    rows, labels = audit_rows()
    got = filter_audit.audit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LAB))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
             for r in got.collect()}
    assert found == brute_audit(rows, labels)


def test_audit_of_nothing_and_one_long_text(spark):
    lab = spark.createDataFrame([], LAB)
    assert filter_audit.audit(spark.createDataFrame([], DOC), lab).count() == 0
    long = [(1, "word " * 300_000, "en", "s", "m", 1, "x", 1)]
    got = filter_audit.audit(spark.createDataFrame(long, DOC), lab).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed) for r in got] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0)]


def test_lehmer_ranks():
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    assert [filter_audit.order_at(r) for r in range(120)] == orders
    assert [filter_audit.lehmer_rank(o) for o in orders] == list(range(120))
    for mask in range(1, 32):  # the intervals of a mask's steps cover every order once
        own = sorted((a, b) for m, _, a, b in filter_audit.removal_intervals() if m == mask)
        assert own[0][0] == 0 and own[-1][1] == 120 and all(x[1] == y[0] for x, y in zip(own, own[1:]))


# ---------------------------------------------------------------- whitening

VEC = "vec_id long, embedding array<float>, label int, component int, n long, id string"


def vectors(n=300, d=12, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(0.4, 0.05, d) + 0.3
    return x.astype(np.float32)


def brute_whitening(x, k=8):
    x = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    a = x - s / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    return a @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for r in x]


def test_whitening_equals_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), 0, 1, 1, "x") for i, v in enumerate(x)]
    bad = [(900, None, 0, 1, 1, "x"), (901, [], 0, 1, 1, "x"), (902, [*x[0][:-1].tolist(), None], 0, 1, 1, "x"),
           (903, [*x[0][:-1].tolist(), math.nan], 0, 1, 1, "x"), (904, [*x[0][:-1].tolist(), -math.inf], 0, 1, 1, "x"),
           (905, x[0][:5].tolist(), 0, 1, 1, "x"), (906, [*x[0][:-1].tolist(), 1e30], 0, 1, 1, "x")]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VEC).repartition(5)).orderBy("vec_id", "component").collect()
    white, share, dev = brute_whitening(x)
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in range(len(x)) for c in range(1, 9)]
    w = np.array([r.whitened for r in got]).reshape(-1, 8)
    assert np.allclose(w * np.sign(w[0]), white * np.sign(white[0]), atol=1e-9)
    assert [r.deviation for r in got[::8]] == dev and {r.n for r in got} == {len(x)}
    assert np.allclose([r.explained for r in got[:8]], share, rtol=1e-10) and got[0].identity_error < 1e-10
    assert len({r.identity_error for r in got}) == 1


def test_whitening_of_badly_conditioned_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(200, 3)) @ np.diag([4000, 1, 0.01])).astype(np.float32)
    x = np.concatenate([x, x[:, :1]], axis=1)  # the last dimension repeats the first
    x[:80] = x[0]
    got = whitening.whiten(spark.createDataFrame([(1, v.tolist(), 0, 1, 1, "x") for v in x], VEC)).collect()
    assert len(got) == 800 and got[0].identity_error < 1e-4
    white, share, _ = brute_whitening(x, 4)
    by = {c: [r for r in got if r.component == c] for c in (1, 2, 3, 4)}
    assert all(r.whitened is None for r in by[4])
    for c in (1, 2, 3):
        mine = sorted(abs(r.whitened) for r in by[c])
        assert np.allclose(mine, sorted(abs(white[:, c - 1])), atol=1e-6)
        assert by[c][0].explained == pytest.approx(share[c - 1], rel=1e-4)


def test_whitening_of_nothing_and_of_one_value(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 1, 1, "x")], VEC)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 0, 1, 1, "x") for i in range(4)] + [(None, [0.5, 0.25], 0, 1, 1, "x")], VEC)).collect()
    assert len(one) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.n == 5 for r in one)


# ---------------------------------------------------------------- toxicity

def toxic_rows(n=1500):
    rng = random.Random(9)
    plain = [f"{a}{b}{c}" for a in ("ta", "mo", "li") for b in ("ren", "sov", "kel") for c in ("a", "o", "i", "ud")]
    listed = sorted(toxicity.TERMS)
    hidden = [f"zorbak{c}" for c in ("a", "es", "in", "ol", "um")]  # no list has these
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(30, 80))]
        toxic = i % 9 == 0
        if toxic:
            source = listed if i % 2 else hidden
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(source))
        rows.append((i, " ".join(text).capitalize(), "en", "s", "m", 1, "x", 1))
        if i % 2 or i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    edge = [(None, "you idiot moron", "en", "s", "m", 1, "x", 1), (5000, None, None, None, None, None, None, None), (5001, "", "en", "s", "m", 1, "x", 1),
            (5002, "plain " * 200_000, "en", "s", "m", 1, "x", 1), (5003, rows[1][1], "en", "s", "m", 1, "x", 1), (5003, rows[1][1], "en", "s", "m", 1, "x", 1)]
    docs = spark.createDataFrame(rows + edge, DOC)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = toxicity.score_toxicity(docs, spark.createDataFrame([*labels, (3, 1, None), (3, 1, 1), (None, 1, 1)], LAB), ~held, keep={"held_out": held}).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    out = [by[i] for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r in out) and sum(r.predicted == (r.doc_id % 9 == 0) for r in out) >= 0.98 * len(out)
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 0 and by[None].predicted == 1
    assert len({r.score for r in got if r.doc_id in (1, 5003)}) == 1


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], LAB)
    assert toxicity.score_toxicity(spark.createDataFrame([], DOC), none, F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, "good day", "en", "s", "m", 1, "x", 1), (2, "you moron, idiot, scum", "en", "s", "m", 1, "x", 1)], DOC)
    assert toxicity.score_toxicity(docs, none, F.lit(False)).count() == 2
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, none, F.lit(True)).collect()}
    assert got[2] > got[1]


def test_label_model_finds_accuracies_and_the_dependent_pair():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    rate = np.where(y[:, None], [0.8, 0.6, 0.5, 0.4], [0.05, 0.1, 0.02, 0.1])
    votes = (rng.random((40_000, 4)) < rate).astype(int)
    votes = np.c_[votes, np.where(rng.random(40_000) < 0.9, votes[:, 3], rng.random(40_000) < 0.2)].astype(int)  # copies voter 3
    seen, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_labels(seen, n.astype(float), np.zeros((len(seen), 2)))
    assert model.prior == pytest.approx(0.2, abs=0.03)
    assert np.allclose(model.accuracy[1][:3], [0.8, 0.6, 0.5], atol=0.05)
    assert (model.parent[4], model.parent[3]).count(3) + (model.parent[3] == 4) == 1
    assert model.correlation[0, 3, 4] > 0.8 and abs(model.correlation[0, 0, 2]) < 0.2
