"""Exact percentile operators against numpy (linear interpolation)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.operators.quantiles import exact_percentiles, global_rank, nested_percentiles


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "a", "b"]), st.integers(-50, 50), st.integers(1, 4)),
                min_size=1, max_size=120))
def test_exact_weighted_percentiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v), w) for g, v, w in rows], "g string, v double, w int")
    got = {r.g: (r.n, r.p50, r.p80) for r in
           exact_percentiles(df, ["g"], "v", [0.5, 0.8], ["p50", "p80"], weight="w", partitions=5).collect()}
    for g in {r[0] for r in rows}:
        expanded = np.repeat([float(v) for gg, v, w in rows if gg == g], [w for gg, v, w in rows if gg == g])
        n, p50, p80 = got[g]
        assert n == len(expanded)
        assert np.isclose(p50, np.quantile(expanded, 0.5))
        assert np.isclose(p80, np.quantile(expanded, 0.8))


def test_exact_percentiles_hot_group_spans_partitions(spark):
    # One group holds almost every row: it must still come out exact.
    vals = [("hot", float(i % 997)) for i in range(20000)] + [("cold", 1.0), ("cold", 3.0)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {r.g: r.med for r in exact_percentiles(df, ["g"], "v", [0.5], ["med"], partitions=16).collect()}
    assert np.isclose(got["hot"], np.median([v for g, v in vals if g == "hot"]))
    assert got["cold"] == 2.0


def test_global_rank_is_a_permutation(spark):
    df = spark.createDataFrame([("d", f"s{i:04d}") for i in range(500)] + [("e", "x")], "dataset string, sid string")
    r = global_rank(df, ["dataset"], "sid", partitions=7).collect()
    pos = sorted((x.sid, x.pos) for x in r if x.dataset == "d")
    assert [p for _, p in pos] == list(range(500))
    assert {x.n for x in r if x.dataset == "d"} == {500}


def test_nested_percentiles_equal_per_cut_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=200)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(vals)], "sid string, wk int, r double")
    cuts = [(1, 50), (2, 120), (0, 200)]
    got = {r.fold: (r.q50, r.q80) for r in nested_percentiles(df, ["sid"], "r", "wk", cuts, [0.5, 0.8],
                                                              ["q50", "q80"]).collect()}
    for f, c in cuts:
        assert np.isclose(got[f][0], np.quantile(vals[:c], 0.5))
        assert np.isclose(got[f][1], np.quantile(vals[:c], 0.8))
