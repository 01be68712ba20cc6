"""Cells tied in a metric: the leaderboard orders them by model and regime, ranks are by the metric alone."""

from shelfcast.plans.report import leaderboard, rank_disagreement

SCHEMA = "dataset string, model string, regime string, MASE double, cost_per_unit double"


def test_leaderboard_ties_by_model_and_regime(spark):
    rows = [("d", m, r, 1.0, c) for m, r, c in (("ma", "zero_shot", 2.0), ("sn", "s", 2.0), ("ma", "fine_tune", 2.0), ("z", "z", 1.0))]
    for order in (rows, rows[::-1]):
        got = sorted((r.place, r.model, r.regime) for r in leaderboard(spark.createDataFrame(order, SCHEMA)).collect())
        assert got == [(1, "z", "z"), (2, "ma", "fine_tune"), (3, "ma", "zero_shot"), (4, "sn", "s")]


def test_cells_tied_in_both_metrics_do_not_disagree(spark):
    rows = [("d", "ma", "fine_tune", 1.0, 2.0), ("d", "ma", "zero_shot", 1.0, 2.0), ("d", "sn", "s", 3.0, 4.0)]
    assert rank_disagreement(spark.createDataFrame(rows, SCHEMA)).count() == 0
