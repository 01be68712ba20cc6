"""The bootstrap by slices and weight vectors against a replay of every draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import bootstrap as B

SCHEMA = "dataset string, model string, regime string, sid string, cost double, demand double, mase double"


def scores(n, dataset="d", seed=0):
    rng = np.random.default_rng(seed)
    return [(dataset, m, "r", f"s{i:05d}", float(rng.random()), float(rng.integers(0, 5)) + 0.5,
             None if i % 17 == 0 else float(round(rng.random(), 2))) for m in ("a", "b") for i in range(n)]


def replay(rows, layout):
    """Every replicate's draws one by one: {(model, b): (MASE, median, cost per unit)}."""
    n = len({r[3] for r in rows})
    out = {}
    for b in range(-1, layout.resamples):
        w = np.ones(n, int) if b < 0 else np.zeros(n, int)
        if b >= 0:
            where = B.draw_hash(layout.seed, b, 0, np.arange(n)) % np.uint64(n) // np.uint64(layout.slice)
            for s in range(layout.slices(n)):
                drawn = n if layout.slices(n) == 1 else int((where == s).sum())
                size = min(layout.slice, n - s * layout.slice)
                for j in range(drawn):
                    w[s * layout.slice + int(B.draw_hash(layout.seed, b, s + 1, [j])[0] % np.uint64(size))] += 1
            assert w.sum() == n
        for m in ("a", "b"):
            own = sorted(r for r in rows if r[1] == m)
            mase = np.array([np.nan if r[6] is None else r[6] for r in own])
            seen = np.repeat(mase, w)
            seen = seen[~np.isnan(seen)]
            out[m, b] = (seen.mean(), np.median(seen), w @ [r[4] for r in own] / (w @ [r[5] for r in own]))
    return out


@pytest.mark.parametrize("n,width", [(60, B.WIDTH), (500, B.WIDTH), (500, 0)])  # no width: most medians lie outside at first
def test_replicates_equal_a_replay(spark, n, width):
    layout = B.Layout(resamples=20, slice=64, block=8)
    rows = scores(n)
    per = spark.createDataFrame(rows, SCHEMA)
    got = B.replicate_stats(per, B.positions(per), layout, width=width).collect()
    want = replay(rows, layout)
    assert len(got) == len(want) == 2 * 21
    for r in got:
        assert (r.MASE, r.MASE_median, r.cost_per_unit) == pytest.approx(want[r.model, r.b], abs=1e-12)


def test_weights_follow_the_law():
    layout = B.Layout(resamples=400, slice=16, block=400)
    n = 50
    draws = layout.slice_draws(0, n, 0, n)
    w = np.concatenate([layout.weights(0, draws[:, s], n, s) for s in range(layout.slices(n))])[:, 1:]
    assert (w.sum(0) == n).all()
    assert w.mean() == 1 and abs(w.var() - (1 - 1 / n)) < 0.05     # binomial(n, 1/n)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15 and abs(np.corrcoef(w[0], w[40])[0, 1]) < 0.15


def test_cells_that_score_different_series_raise(spark):
    rows = scores(6)
    with pytest.raises(Exception, match="different series"):
        B.positions(spark.createDataFrame(rows[:-1], SCHEMA)).collect()
    with pytest.raises(Exception, match="different series"):
        B.positions(spark.createDataFrame([*rows, rows[-1]], SCHEMA)).collect()


def test_no_shuffle_of_weights(spark):
    """What a slice sends does not grow with its series: one vector per entry and the candidates of the medians."""
    layout = B.Layout(resamples=40, slice=4096, block=40)
    sent = []
    for n in (400, 1600):
        per = spark.createDataFrame(scores(n), SCHEMA)
        pos = B.positions(per).cache()
        rows = per.join(pos.select("dataset", "sid", "pos", "n"), ["dataset", "sid"]).join(B.median_ranks(per), [*B.CELL, "sid"], "left")
        sums, near = B.cell_vectors(rows, B.drawn_slices(pos, layout), layout, True, width=1)
        assert sums.count() == 2 * layout.slices(n)
        sent.append(near.count())
    assert sent[1] < 2.5 * sent[0]      # by the root of the number of series


def test_two_datasets_and_no_rows(spark):
    per = spark.createDataFrame(scores(30) + scores(45, "e", 1), SCHEMA)
    out = B.significance(per, 50).collect()
    assert {(r.dataset, r.n) for r in out} == {("d", 30), ("e", 45)} and len(out) == 6
    assert B.significance(per.filter(F.lit(False)), 50).count() == 0
