"""P7 has every week, R8 every store of the plan, T16 the model's own defaults."""

import inspect

import pytest
from pyspark.sql import functions as F

from shelfcast.plans import forest
from tests.conftest import SF001


def test_wide_panel_has_every_week(spark):
    import __spark_entry__ as E
    long = E.queries()["weekly_panel"](spark, SF001).groupBy("sid").agg(F.sum("y").alias("y")).collect()
    wide = E.queries()["weekly_panel_wide"](spark, SF001)
    assert wide.columns == ["sid", *[f"w{k}" for k in range(357)]]
    assert {r.sid: sum(r[1:]) for r in wide.collect()} == pytest.approx({r.sid: r.y for r in long})


def test_every_store_of_the_plan_is_placed(spark):
    import __spark_entry__ as E
    plan, placed = (E.queries()[q](spark, SF001) for q in ("order_plan", "plan_by_location"))
    assert placed.count() == plan.count() and placed.select("store_id").distinct().count() == 5


def test_seed_robustness_uses_the_models_defaults(spark, monkeypatch):
    import __spark_entry__ as E
    sign, used = inspect.signature(forest.fit_predict), {}

    def look(*args, **kwargs):
        used.update(kwargs)
        raise InterruptedError
    monkeypatch.setattr(forest, "fit_predict", look)
    with pytest.raises(InterruptedError):
        E.queries()["seed_robustness"](spark, SF001)
    assert all(used.get(k, sign.parameters[k].default) == sign.parameters[k].default for k in ("depth", "trees"))
