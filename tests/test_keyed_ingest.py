"""Surrogate keys of uploads (R2, R3), the forecast run over all companies (M7, K2, R4), alignment."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import dims as D
from shelfcast.plans.orders import aggregate_plan, next_month_forecast
from shelfcast.plans.run_forecast import run_forecast
from shelfcast.plans.scoring import score_with
from shelfcast.streaming.ingest import apply_upload, named_sales

SALES = "item_id string, store_id string, sold int, date date"


@pytest.mark.parametrize("bucket_rows", [1 << 16, 7])
def test_ids_without_gaps_and_the_same_again(spark, bucket_rows):
    names = spark.createDataFrame([(c, f"n{i}") for c in (1, 2) for i in range(100)], "company_id long, name string")
    one = {(r.company_id, r.name): r.id for r in D.assign_keys(names, ["company_id", "name"], 40, bucket_rows).collect()}
    two = {(r.company_id, r.name): r.id for r in D.assign_keys(names.repartition(5), ["company_id", "name"], 40, bucket_rows).collect()}
    assert one == two and sorted(one.values()) == list(range(41, 241))
    assert D.assign_keys(names.limit(0), ["company_id", "name"]).count() == 0


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_sales_hold_keys_and_a_replay_gives_the_same(spark, tmp_path):
    tables = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "s", 1, day(0)), ("b", "s", 2, day(1)), (None, "s", 3, day(1)), ("a", None, 3, day(1)),
                                   ("c", "s", -1, day(1)), ("c", "s", None, day(1))], SALES)
    second = spark.createDataFrame([("d", "s", 1, day(0)), ("a", "r", 2, day(1))], SALES)
    apply_upload(first, 1, tables, "u1")
    apply_upload(second, 1, tables, "u2")
    apply_upload(second, 2, tables, "u3")  # the same names of another company are others

    def state():
        return {t: sorted(map(str, spark.read.parquet(os.path.join(tables, t)).collect())) for t in ("sales", "products", "stores", "rejects")}
    before = state()
    apply_upload(first, 1, tables, "u1")
    apply_upload(second, 1, tables, "u2")
    assert state() == before
    sales = spark.read.parquet(f"{tables}/sales")
    assert set(sales.columns) == {"company_id", "store_key", "item_key", "sold", "date", "upload"}
    for kind, n in (("products", 5), ("stores", 4)):
        ids = [r.id for r in spark.read.parquet(f"{tables}/{kind}").collect()]
        assert sorted(ids) == list(range(1, n + 1))
    assert len(before["rejects"]) == 4
    got = sorted((r.company_id, r.item_id, r.store_id, r.sold) for r in named_sales(spark, tables).collect())
    assert got == [(1, "a", "r", 2), (1, "a", "s", 1), (1, "b", "s", 2), (1, "d", "s", 1), (2, "a", "r", 2), (2, "d", "s", 1)]


def test_run_forecast_equals_each_company_alone(spark, tmp_path):
    tables, rng = str(tmp_path / "t"), np.random.default_rng(5)
    alone = {}
    for company, start, days in ((1, 0, 90), (2, 40, 120), (3, 10, 70)):
        rows = [(i, s, int(rng.integers(0, 9)), day(start + k)) for i in ("a", "b") for s in ("s", "r") for k in range(days) if rng.random() < 0.7]
        sales = spark.createDataFrame(rows, SALES)
        apply_upload(sales, company, tables, f"u{company}")
        alone |= {(company, r.store_id, r.item_id): r.forecasted_sold for r in aggregate_plan(next_month_forecast(sales)).collect()}
    for companies in (None, [2], None):  # runs again replace themselves
        plan = run_forecast(spark, tables, "2024-07-01", companies)
        got = {(r.company_id, r.store_id, r.item_id): r.forecasted_sold for r in plan.collect()}
        assert got == {k: v for k, v in alone.items() if companies is None or k[0] in companies}
    run_forecast(spark, tables, "2024-08-01", [3]).collect()
    stored = spark.read.parquet(f"{tables}/forecasts")
    assert {(r[0], r[1]): r[2] for r in stored.groupBy("company_id", F.col("forecasted_at").cast("string")).count().collect()} == {
        (1, "2024-07-01"): 112, (2, "2024-07-01"): 112, (3, "2024-07-01"): 112, (3, "2024-08-01"): 112}


def test_alignment_raises_for_missing_and_extra(spark, make_panel):
    panel = make_panel({"x": [1, 2, 3, 4], "y": [2, 3, 4, 5]})

    def scorer(steps):
        return lambda hist: np.repeat(hist[:, -1:, None], steps, 1).repeat(2, 2)
    good = score_with(panel, 2, scorer(2), horizon=2)
    assert good.columns == ["sid", "step", "wk", "q50", "q_cr"]
    assert sorted((r.sid, r.step, r.wk, r.q50) for r in good.collect()) == [("x", 1, 2, 2.0), ("x", 2, 3, 2.0), ("y", 1, 2, 3.0), ("y", 2, 3, 3.0)]
    with pytest.raises(Exception, match="no forecast for"):
        score_with(panel, 2, scorer(1), horizon=2).collect()
    with pytest.raises(Exception, match="outside the panel"):
        score_with(panel, 2, scorer(3), horizon=2).collect()
