"""One pass over the raw sales; calendars, alignment and percentiles built on it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.config import TESTDATA_SPEC
from shelfcast.operators import panel as P
from shelfcast.operators.quantiles import selected_percentiles
from tests.conftest import SF001


def test_raw_sales_are_read_once(spark, tmp_path, monkeypatch):
    """Jobs that run while the plan is built count too: every evaluated sales row passes an accumulator."""
    import pandas as pd

    from shelfcast.plans.catalog import QUERIES
    from shelfcast.plans import catalog, experiment
    seen = spark.sparkContext.accumulator(0)
    plain = experiment.sales_view

    def counted(src, level="region", **kw):
        sales = plain(src, level, **kw)

        @F.pandas_udf("double")
        def tick(x: pd.Series) -> pd.Series:
            seen.add(len(x))
            return x
        return sales.withColumn("sold", tick.asNondeterministic()(F.col("sold").cast("double")))
    monkeypatch.setattr(experiment, "sales_view", counted)
    monkeypatch.setattr(catalog, "sales_view", counted)
    rows = spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    for name in ("weekly_panel", "daily_panel", "order_plan", "weekly_panel_returns", "panel_profile"):
        before = seen.value
        QUERIES[name](spark, SF001).collect()
        assert seen.value - before == rows, name


def test_dims_and_quality_scan_the_fact_once(spark):
    import __spark_entry__ as E
    for name in ("dim_upsert", "sales_quality"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_shipdate") and plan.count("Relation [l_orderkey") == 1, name


def test_filled_weeks(spark):
    sums = spark.createDataFrame([("a", 2, 5.0), ("a", 0, 1.0), ("b", 3, 7.0), ("out", 9, 1.0), ("c", -2, 4.0), ("c", 1, 2.0), ("n", 1, None)],
                                 "sid string, wk int, y double")
    spec = P.replace(TESTDATA_SPEC, weeks=4)
    got = P.densify_weeks(sums, spec)
    by = {s: [r.y for r in got.filter(F.col("sid") == s).orderBy("wk").collect()] for s in "a b out c n".split()}
    assert by == {"a": [1, 0, 5, 0], "b": [0, 0, 0, 7], "out": [0] * 4, "c": [0, 2, 0, 0], "n": [0] * 4}
    assert got.filter("wk = 3").first().week_start == spec.epoch + dt.timedelta(days=21)


def test_daily_panel_of_no_sales(spark):
    none = spark.createDataFrame([], "item_id string, store_id string, sold int, date date")
    assert P.daily_panel(none).count() == 0


def test_alignment_raises_on_either_side(spark):
    panel = spark.createDataFrame([("a", w) for w in range(4)] + [("b", w) for w in range(4)], "sid string, wk int")
    rows = [(s, w, 1.0) for s in "ab" for w in (4, 5)]
    fc = spark.createDataFrame(rows, "sid string, wk int, q50 double")
    assert sorted(map(tuple, P.align_to_panel(fc, panel, 4, 2).collect())) == rows
    for bad, text in ((rows[1:], "no forecast for a week 4"), ([*rows, ("c", 4, 1.0)], "outside the panel: c week 4"),
                      ([*rows, ("a", 9, 1.0)], "outside the panel: a week 9"), ([*rows, rows[0]], "more than one forecast for a week 4")):
        with pytest.raises(Exception, match=text):
            P.align_to_panel(spark.createDataFrame(bad, "sid string, wk int, q50 double"), panel, 4, 2).collect()


def test_selected_percentiles_of_many_ties_and_extremes(spark):
    rng = np.random.default_rng(4)
    n = 200_000
    a = np.where(rng.random(n) < 0.7, 0.25, rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n))
    b = rng.normal(size=n)
    pdf = {"g": np.where(np.arange(n) % 10 < 9, "hot", "cold"), "a": a, "b": b}
    import pandas as pd
    frame = pd.DataFrame(pdf)
    frame.loc[::7, "b"] = None
    df = spark.createDataFrame(frame).select("g", "a", F.when(~F.isnan("b"), F.col("b")).alias("b"))
    got = {r.g: r for r in selected_percentiles(df, ["g"], {"a": ["a1", "a5", "a9"], "b": ["b1", "b5", "b9"]}, [0.1, 0.5, 0.9]).collect()}
    for g, own in frame.groupby("g"):
        for c in "ab":
            v = own[c].dropna()
            want = np.quantile(v, [0.1, 0.5, 0.9])
            assert [got[g][f"{c}{k}"] for k in (1, 5, 9)] == pytest.approx(want, rel=1e-12, abs=0)
            assert got[g][f"n_{c}"] == len(v)


def test_selected_percentiles_null_keys_and_signs(spark):
    df = spark.createDataFrame([(None, -1.0), (None, -3.0), ("x", -0.0), ("x", 0.0), ("x", 2.0), ("y", None)], "g string, v double")
    got = {r.g: r.m for r in selected_percentiles(df, ["g"], {"v": ["m"]}, [0.5]).collect()}
    assert got == {None: -2.0, "x": 0.0}
