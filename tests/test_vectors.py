"""Hand-worked vectors (FIXTURES §3)."""

import math

from pyspark.sql import functions as F

from shelfcast.config import COST_SETS, Costs
from shelfcast.functions.columns import half_even, newsvendor_cost, order_levels, percent_label, served
from shelfcast.operators.features import seasonal_residuals
from shelfcast.operators.quantiles import group_percentiles


def _res(spark, make_panel):
    p = make_panel({"a": [1, 2, 3, 4, 6, 5], "b": [None, 2, 2, 6, 4, 9]})
    return seasonal_residuals(p, 2)


def test_seasonal_residuals(spark, make_panel):
    r = _res(spark, make_panel)
    got = {sid: [x.residual for x in sorted(rows, key=lambda x: x.wk)]
           for sid, rows in _group(r.collect()).items()}
    assert got["a"] == [2, 2, 3, 1]
    assert got["b"] == [4, 2, 3]          # NULL 4 2 3: the NULL is dropped


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sid, []).append(r)
    return out


def test_residual_quantiles_and_scale(spark, make_panel):
    r = _res(spark, make_panel)
    q = {x.sid: (x.q50, x.q80) for x in group_percentiles(r, ["sid"], "residual", [0.5, 0.8], ["q50", "q80"]).collect()}
    assert q["a"] == (2.0, pytest_approx(2.4))
    assert q["b"] == (3.0, pytest_approx(3.6))
    scale = {x.sid: x.s for x in r.groupBy("sid").agg(F.avg(F.abs("residual")).alias("s")).collect()}
    assert scale == {"a": 2.0, "b": 3.0}


def pytest_approx(v):
    import pytest
    return pytest.approx(v, abs=1e-12)


def test_newsvendor_cost_and_fill(spark):
    rows = [(5.0, 3.0), (0.0, 1.0), (2.0, 2.0), (2.0, 4.0)]
    df = spark.createDataFrame(rows, "o double, d double")
    c = Costs(1.0, 4.0)
    out = df.select(newsvendor_cost("o", "d", c.holding, c.stockout).alias("c"), served("o", "d").alias("s"), "d")
    costs = [x.c for x in out.collect()]
    assert costs == [2.0, 4.0, 0.0, 8.0]
    agg = out.agg((F.sum("c") / F.sum("d")).alias("cpu"), (F.sum("s") / F.sum("d")).alias("fill")).first()
    assert math.isclose(agg.cpu, 1.4) and math.isclose(agg.fill, 0.7)


def test_critical_ratio():
    assert order_levels(COST_SETS["m5"]) == (0.5, 0.8)
    assert math.isclose(order_levels(COST_SETS["favorita"])[1], 0.666667, abs_tol=1e-6)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (7.49,)], "x double")
    assert [r.r for r in df.select(half_even("x").alias("r")).collect()] == [0, 2, 2, 7]


def test_percent_label():
    assert percent_label(0.8) == 80
    assert percent_label(2 / 3) == 66
