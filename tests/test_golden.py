"""Golden rows (FIXTURES §4), brand × region at sf0.01, and the next-month plan totals."""

import pytest
from pyspark.sql import functions as F

from shelfcast.plans.experiment import Study, best_params, holdout_summary, tuning_trials
from tests.conftest import SF001, SF01

MA_GOLDEN = {  # window: (validation cost/unit, MASE mean, MASE median, cost/unit, fill)
    2: (1.788808, 0.874038, 0.803627, 1.785278, 0.809285),
    4: (1.674751, 0.773548, 0.708616, 1.682560, 0.836280),
    6: (1.647397, 0.715909, 0.650994, 1.612462, 0.844627),
    8: (1.607084, 0.709712, 0.656276, 1.605366, 0.846094),
    13: (1.608221, 0.699173, 0.641984, 1.573296, 0.847882),
    26: (1.583169, 0.707777, 0.640773, 1.558711, 0.853530),
    52: (1.568785, 0.710400, 0.644165, 1.565298, 0.852693),
}


@pytest.fixture(scope="module")
def study(spark):
    return Study(spark, SF01, "region")


def test_seasonal_naive_golden(study):
    s = holdout_summary(study, "seasonal_naive").first()
    assert (round(s.MASE, 6), round(s.MASE_median, 6), round(s.cost_per_unit, 6), round(s.fill_rate, 6)) == \
        (0.958500, 0.961590, 2.030375, 0.832042)
    v = tuning_trials(study, "seasonal_naive").first()
    assert round(v.cost_per_unit, 6) == 1.945680


def test_moving_average_golden(study):
    summ = {r.window: r for r in holdout_summary(study, "moving_average").collect()}
    trials = {r.window: r.cost_per_unit for r in tuning_trials(study, "moving_average").collect()}
    for w, (val, mase, med, cpu, fill) in MA_GOLDEN.items():
        r = summ[w]
        assert round(trials[w], 6) == val
        assert (round(r.MASE, 6), round(r.MASE_median, 6), round(r.cost_per_unit, 6), round(r.fill_rate, 6)) == \
            (mase, med, cpu, fill)
    best = best_params(tuning_trials(study, "moving_average"), "moving_average").first()
    assert best.window == 52            # the grid edge


def test_eligible_count_brand_nation(spark):
    assert Study(spark, SF01, "nation").eligible.count() == 574


@pytest.mark.parametrize("root,units", [(SF001, 1848), (SF01, 15292)])
def test_next_month_plan_totals(spark, root, units):
    from shelfcast.plans.catalog import QUERIES
    fc = QUERIES["next_month_forecast"](spark, root)
    agg = fc.agg(F.count(F.lit(1)).alias("n"), F.sum("forecasted_sold").alias("u"),
                 F.count(F.when(F.col("forecasted_sold") != 0, 1)).alias("nz")).first()
    assert agg.n == 3500
    assert agg.u == units
