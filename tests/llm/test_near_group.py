"""A group of near copies whose members differ by 5 to 25 %, many of which do not link, against all pairs."""

import os
import random

import pytest

from shelfcast.llm import common, exact_dedup, jaccard_join


def shingle_set(t, width):
    w = t.split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


@pytest.fixture(scope="module")
def group():
    rng = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(90):
        own = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4, 6, 8])):
            own[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts + [" ".join(f"far{k}_{i}" for i in range(50)) for k in range(5)]


def test_rounds_lose_no_link(spark, group):
    sets = [shingle_set(t, 5) for t in group]
    comp = list(range(len(group)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert 8 < len(set(comp)) < 80
    docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[i] for i in range(len(group))] == comp
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == set(comp)


def test_exact_copies_repeated_rows_and_clashing_names(spark):
    rows = [(1, "A b", "s"), (2, "a B", "s"), (3, "c", "s"), (3, "c", "t"), (None, "c", "u"), (None, "d", "v"), (None, "d", "w"), (4, None, "x"),
            (5, "", "y"), (6, "unique", "z"), (6, "other", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string").selectExpr("*", "__sha as __id", "doc_id as n")
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    out = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert out == sorted([("2", "a B"), ("3", "c"), ("None", "d"), ("5", ""), ("6", "unique"), ("6", "other")])
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


@pytest.fixture
def written(monkeypatch):
    """Of each scratch table that is written: whether it has prefixes, its folder, how many with prefixes are there then."""
    tables, write = [], common.scratch_table

    def noted(df, name):
        out, wide = write(df, name), "p0" in df.columns
        there = sum(w and os.path.exists(f) for w, f, _ in tables)
        tables.append((wide, os.path.dirname((out.inputFiles() or ["none/"])[0].removeprefix("file://")), there + wide))
        return out
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "scratch_table", noted)
    return tables


def test_prefixes_are_not_copied_for_components(spark, group, written):
    """At most two tables with prefixes are on the disk, while one is made from the other; none is left."""
    docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
    jaccard_join.keep_one(docs).collect()
    assert max(there for _, _, there in written) == sum(wide for wide, _, _ in written) == 2
    assert ["near_copies" in f for _, f, _ in written if os.path.exists(f)] == [True]


def test_settled_components_take_one_round(spark, written):
    links = spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "a long, b long")
    got = {r.id: r.comp for r in jaccard_join.components(links, "settled").collect()}
    assert got == {5: 1, 7: 1, 3: 2} and len(written) == 2
    assert {r.id: r.comp for r in jaccard_join.components(spark.createDataFrame([(4, 5), (3, 4), (9, 3)], "a long, b long"), "path").collect()} == {4: 3, 5: 3, 9: 3}
    assert jaccard_join.components(links.limit(0), "none").count() == 0
