"""The pooled forest as tables, its tuning, and cell records."""

import threading

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from shelfcast.config import PanelSpec
from shelfcast.plans import forecasters, forest, records
from shelfcast.plans import report as R
from shelfcast.plans.experiment import Study
from shelfcast.session import side_by_side

SMALL = [{"depth": d, "trees": t} for d in (2, 4) for t in (2, 3)]

FORECAST = """
WITH RECURSIVE ctx AS (
  SELECT sid, list(y ORDER BY wk) AS v, 1 + avg(y) AS scale FROM panel
  WHERE wk >= {cut} - 52 AND wk < {cut} AND y IS NOT NULL GROUP BY sid HAVING count(*) = 52),
rows AS (SELECT sid, scale, step, list_concat(list_transform(v, lambda a: a / scale), [step::DOUBLE]) AS x FROM ctx, range(4) r(step)),
walk AS (
  SELECT sid, step, tree, 0 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.sid, w.step, w.tree, CASE WHEN r.x[n.feature + 1] <= n."limit" THEN n."left" ELSE n."right" END
  FROM walk w JOIN nodes n USING (tree, node) JOIN rows r USING (sid, step) WHERE n.feature IS NOT NULL)
SELECT sid, step + 1 AS step, greatest(0, least(avg(l_q50), avg(l_q_cr)) * any_value(scale)) AS q50,
       greatest(0, greatest(avg(l_q50), avg(l_q_cr)) * any_value(scale)) AS q_cr
FROM walk JOIN leaves USING (tree, node) JOIN rows USING (sid, step) WHERE tree < {trees} GROUP BY sid, step ORDER BY sid, step
"""


@pytest.fixture(scope="module")
def study(spark):
    return Study(spark, SF001, "region")


def test_duckdb_forecasts_from_the_tables(spark, study, tmp_path):
    cut = study.spec.test_cut
    train = forest.training_rows(study.panel, cut, 4)
    tables = forest.fit_tables(train, study.levels, depth=4, trees=5)
    tables.write(str(tmp_path / "forest"))
    study.panel.write.parquet(str(tmp_path / "panel"))
    again = forest.read_forest(spark, str(tmp_path / "forest"))
    assert again.depth == 4
    got = sorted(map(tuple, forest.forecast_from(again, study.panel, cut, study.spec, (3, 5)).select("trees", "sid", "step", "q50", "q_cr").collect()))
    db = duckdb.connect()
    for t, path in (("nodes", "forest/nodes"), ("leaves", "forest/leaves"), ("panel", "panel")):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{path}/*.parquet'")
    want = [(k, *r) for k in (3, 5) for r in db.execute(FORECAST.format(cut=cut, trees=k)).fetchall()]
    assert len(got) == len(want) > 0
    assert all(g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9) for g, w in zip(got, sorted(want)))
    # a leaf's quantiles are those of the training targets that the tables lead there
    at = forest.leaves_of(train.select("x", "target"), tables.nodes, 4).toPandas()
    own = at.groupby(["tree", "node"])["target"].quantile(0.8)
    for r in tables.leaves.collect():
        assert r.l_q_cr == pytest.approx(own[r.tree, r.node], rel=1e-9)
    assert sum(r.n for r in tables.leaves.collect()) == 5 * train.count()


def test_one_series_and_none(spark, make_panel):
    spec = PanelSpec(epoch=None, weeks=80)
    one = make_panel({"a": [float(k % 5) for k in range(80)], "short": [None] * 60 + [1.0] * 20})
    got = forest.fit_predict(one, 76, spec, (0.5, 0.8), depth=2, trees=2, min_leaf=1).collect()
    assert sorted((r.sid, r.step) for r in got) == [("a", s) for s in (1, 2, 3, 4)]  # too short a history: no forecast
    assert all(0 <= r.q50 <= r.q_cr <= 5 for r in got)


def test_tuned_forest_is_a_cell(spark, study, tmp_path, monkeypatch):
    monkeypatch.setitem(forecasters.GRIDS, "quantile_forest", SMALL)
    monkeypatch.setitem(records.DEFAULTS, "quantile_forest", {"depth": 2, "trees": 2})
    recs, per = records.fitted_cells(study)
    records.write_records(recs, per, str(tmp_path))
    recs, per = records.read_records(spark, str(tmp_path))
    by = {(r.model, r.regime): r for r in recs.collect()}
    assert set(by) == {("seasonal_naive", "statistical"), *((m, r) for m in ("moving_average", "quantile_forest") for r in ("zero_shot", "fine_tune"))}
    assert all(r.seconds > 0 and r.summary.n_series == study.eligible.count() for r in by.values())
    tuned = by["quantile_forest", "fine_tune"]
    assert [t.grid_idx for t in tuned.tuning] == [0, 1, 2, 3] and by["quantile_forest", "zero_shot"].tuning is None
    best = min(tuned.tuning, key=lambda t: (t.cost_per_unit, t.grid_idx))
    assert tuned.params == best.params
    # the validation cost of each entry is that of both folds together
    scored = study.per_series("quantile_forest")
    for t, g in zip(tuned.tuning, SMALL):
        own = scored.filter((F.col("fold") >= 1) & (F.col("depth") == g["depth"]) & (F.col("trees") == g["trees"]))
        assert own.select("fold").distinct().count() == 2
        assert t.cost_per_unit == pytest.approx(own.agg(F.sum("cost") / F.sum("demand")).first()[0])
    rep = {r.model: r for r in records.tuning_report(recs).collect()}
    assert set(rep) == {"moving_average", "quantile_forest"} and rep["quantile_forest"].configs == 4
    assert rep["quantile_forest"].minutes == pytest.approx(tuned.seconds / 60) and rep["quantile_forest"].best == best.cost_per_unit
    board = R.leaderboard(records.cell_table(recs)).collect()
    assert sorted(r.place for r in board) == [1, 2, 3, 4, 5]
    tests = R.planned_contrasts(records.cell_table(recs), per, ["quantile_forest"], "zero_shot", "fine_tune", 50,
                                make_models=("seasonal_naive", "moving_average")).collect()
    assert len(tests) == 3 and all(r.diff == pytest.approx(r.cost_a - r.cost_b) for r in tests)
    # a cell that is run again replaces its own rows only
    again = recs.filter("model = 'seasonal_naive'").withColumn("seconds", F.lit(7.5))
    records.write_records(again, per.filter("model = 'seasonal_naive'"), str(tmp_path))
    recs, per = records.read_records(spark, str(tmp_path))
    assert recs.count() == 5 and recs.filter("seconds = 7.5").count() == 1 and per.count() == 5 * study.eligible.count()


def test_series_without_a_scale_are_counted(spark):
    from shelfcast.operators.metrics import summarize
    rows = [("c", "a", 1.0, 2.0, 1.0, 0.5), ("c", "b", 1.0, 2.0, 1.0, None), ("c", "d", 1.0, 2.0, 1.0, None)]
    per = spark.createDataFrame(rows, "cell string, sid string, cost double, demand double, served double, mase double")
    got = summarize(per, ["cell"], unscaled=True).first()
    assert (got.MASE, got.MASE_median, got.n_series, got.n_unscaled) == (0.5, 0.5, 3, 2)
    assert "n_unscaled" not in summarize(per, ["cell"]).columns


def test_side_by_side(spark):
    seen = set()

    def job(k):
        seen.add(threading.get_ident())
        return spark.range(k).count()
    assert side_by_side(spark, [lambda k=k: job(k) for k in (5, 3, 9)], width=2) == [5, 3, 9]
    assert side_by_side(spark, []) == [] and threading.get_ident() not in seen

    def fail():
        raise ValueError("no fit")
    with pytest.raises(ValueError, match="no fit"):
        side_by_side(spark, [fail, lambda: 1])
