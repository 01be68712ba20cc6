"""op7: a gram with more anchors than a bucket may hold goes by its windows, with the results of the merge."""

import pytest

from shelfcast.llm import suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"p{i * 37 % 97}" for i in range(60))
    rows = [(i, f"{'x' * (i % 7)}{i * i} before {i} {passage[i % 3:]}{' and' * (i % 2)} after {i} {i ** 3} " * (1 + i % 2)) for i in range(80)]
    return spark.createDataFrame([*rows, (80, None), (81, ""), (None, rows[3][1]), (5, rows[5][1])], "doc_id long, text string")


@pytest.mark.parametrize("hot", [1, 20])
def test_hot_grams_give_the_same(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 4096)   # several runs
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(map(str, suffix_dedup.remove_repeats(docs).select(*cols).collect()))
    assert sorted(map(str, suffix_dedup.remove_repeats(docs, hot=hot).select(*cols).collect())) == want
    assert any("n_removed=0" not in r for r in want)


def test_no_bucket_holds_a_hot_gram(spark, docs, monkeypatch):
    """The merge sees no row of a gram above the bound."""
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 4096)

    def held(runs, length):
        assert sum(len(r[1]) for r in runs) == 0
        return iter(())
    monkeypatch.setattr(suffix_dedup, "loser_tree", held)
    assert suffix_dedup.remove_repeats(docs, hot=1).filter("n_removed > 0").count() > 70
