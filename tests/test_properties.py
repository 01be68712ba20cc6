"""Properties on the sf0.001/sf0.01 brand × region panel."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.operators.bootstrap import significance
from shelfcast.operators.panel import fold_splits
from shelfcast.plans.experiment import Study
from tests.conftest import SF01


@pytest.fixture(scope="module")
def study(spark):
    return Study(spark, SF01, "region")


def test_forecasts_non_negative_and_ordered(study):
    for model in ("seasonal_naive", "moving_average"):
        fc = study.forecasts(model)
        bad = fc.filter((F.col("q50") < 0) | (F.col("q_cr") < 0) | (F.col("q50") > F.col("q_cr") + 1e-9)).count()
        assert bad == 0


def test_scores_in_range(study):
    per = study.per_series("moving_average")
    agg = per.agg(F.min("cost").alias("c"), (F.sum("served") / F.sum("demand")).alias("fill")).first()
    assert agg.c >= 0 and 0 <= agg.fill <= 1


def test_listed_never_turns_false(study):
    lp = study.listed.withColumn("prev", F.lag("y").over(Window.partitionBy("sid").orderBy("wk")))
    assert lp.filter(F.col("prev").isNotNull() & F.col("y").isNull()).count() == 0


def test_no_fold_sees_its_future(study):
    fs = fold_splits(study.panel, study.spec).collect()
    cuts = dict(study.cuts(include_test=False))
    assert all(r.n_train <= cuts[r.fold] for r in fs)


def test_bootstrap_identical_cells_and_swap(study, spark):
    per = study.per_series("seasonal_naive").filter("fold = 0").select("sid", "cost", "demand", "mase")
    cells = (per.withColumn("model", F.lit("a")).unionByName(per.withColumn("model", F.lit("b")))
                .withColumn("regime", F.lit("r")).withColumn("dataset", F.lit("d")))
    same = significance(cells, 50).collect()
    assert all(r.p_value == 1.0 and r.diff == 0 for r in same)
    ma = study.per_series("moving_average").filter("fold = 0 AND window = 4").select("sid", "cost", "demand", "mase")
    two = (per.withColumn("model", F.lit("a")).unionByName(ma.withColumn("model", F.lit("b")))
              .withColumn("regime", F.lit("r")).withColumn("dataset", F.lit("d")))
    swapped = (per.withColumn("model", F.lit("b")).unionByName(ma.withColumn("model", F.lit("a")))
                  .withColumn("regime", F.lit("r")).withColumn("dataset", F.lit("d")))
    ab = {r.metric: r for r in significance(two, 50).collect()}
    ba = {r.metric: r for r in significance(swapped, 50).collect()}
    for m in ab:
        assert abs(ab[m].diff + ba[m].diff) < 1e-12
        assert abs(ab[m].p_value - ba[m].p_value) < 1e-12
