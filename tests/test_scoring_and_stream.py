"""Differential M6 = M1, stream = batch (S7), sources/sinks round trips, strict lookups."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfcast.config import TESTDATA_SPEC
from shelfcast.operators import dims as D
from shelfcast.plans.experiment import Study
from shelfcast.plans.forecasters import seasonal_naive
from shelfcast.plans.scoring import score_with, seasonal_naive_scorer
from tests.conftest import SF001


def test_udf_scorer_equals_spark_seasonal_naive(spark):
    st = Study(spark, SF001, "region")
    cut = TESTDATA_SPEC.test_cut
    a = seasonal_naive(st.panel, [(0, cut)], TESTDATA_SPEC, st.levels).select("sid", "step", "q50", "q_cr")
    b = score_with(st.panel, cut, seasonal_naive_scorer(52, 4, st.levels)).select("sid", "step", "q50", "q_cr")
    ra = {(r.sid, r.step): (round(r.q50, 9), round(r.q_cr, 9)) for r in a.collect()}
    rb = {(r.sid, r.step): (round(r.q50, 9), round(r.q_cr, 9)) for r in b.collect()}
    assert ra and ra == rb


def _write_upload(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("item_id,store_id,sold,date\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    from shelfcast.sources.files import read_sales_csv
    from shelfcast.streaming.ingest import apply_upload, ingest_stream, named_sales
    up1 = [(1, "s1", 3, "2024-01-01"), (2, "s1", 1, "2024-01-02")]
    up2 = [(1, "s2", 5, "2024-01-03"), (3, "s1", 2, "2024-01-03"), (1, "s1", 3, "2024-01-01"), (9, "s9", -5, "2024-01-03")]
    land = str(tmp_path / "landing")
    _write_upload(land, "a.csv", up1)
    _write_upload(land, "b.csv", up2)
    stream_tables, batch_tables = str(tmp_path / "st"), str(tmp_path / "bt")
    q = ingest_stream(spark, land, stream_tables, str(tmp_path / "ckpt"), company_id=1)
    q.awaitTermination(120)
    for name in ("a.csv", "b.csv"):
        apply_upload(read_sales_csv(spark, os.path.join(land, name)), 1, batch_tables)
    for t in ("sales", "rejects", "products", "stores"):
        s = sorted(map(tuple, spark.read.parquet(f"{stream_tables}/{t}").drop("upload").collect()))
        b = sorted(map(tuple, spark.read.parquet(f"{batch_tables}/{t}").drop("upload").collect()))
        assert s == b, t
    # No de-duplication: the repeated row is there twice (G17); ids are text (item "1").
    sales = named_sales(spark, batch_tables)
    assert sales.filter("item_id = '1' AND store_id = 's1'").count() == 2
    assert spark.read.parquet(f"{batch_tables}/products").count() == 3
    # A row with a negative quantity is rejected and adds no product or store.
    assert [r.sold for r in spark.read.parquet(f"{batch_tables}/rejects").collect()] == [-5]


def test_upload_run_again_counts_once(spark, tmp_path):
    from shelfcast.sources.files import read_sales_csv
    from shelfcast.streaming.ingest import apply_upload
    land, tables = str(tmp_path / "landing"), str(tmp_path / "t")
    _write_upload(land, "a.csv", [(1, "s1", 3, "2024-01-01"), (1, "s1", 3, "2024-01-01")])
    for name in ("q-0", "q-0", "q-1"):  # a batch that runs twice, then another upload of the same file
        apply_upload(read_sales_csv(spark, os.path.join(land, "a.csv")), 1, tables, name)
    assert spark.read.parquet(f"{tables}/sales").count() == 4
    assert spark.read.parquet(f"{tables}/products").count() == 1


def test_table_that_cannot_be_read_is_no_missing_table(spark, tmp_path):
    from shelfcast.sources.sinks import cached_table
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        cached_table(spark, str(tmp_path / "broken"), lambda: pytest.fail("built anew")).collect()


def test_wide_csv_and_results_json(spark, tmp_path):
    from shelfcast.operators.panel import unpivot_days, weekly_from_days
    from shelfcast.sources.files import read_results, read_wide_csv
    p = tmp_path / "wide.csv"
    p.write_text("id,cat,d_1,d_2,d_3,d_4,d_5,d_6,d_7,d_8\nx,c,1,1,1,1,1,1,1,9\n")
    wk = weekly_from_days(unpivot_days(read_wide_csv(spark, str(p))), 8, dt.date(2011, 1, 29)).collect()
    assert [(r.sid, r.wk, r.y) for r in wk] == [("x", 0, 7.0)]   # partial last week dropped
    doc = {"dataset": "d", "model": "m", "regime": "r", "params": "{}", "seconds": 1.0,
           "summary": {"MASE": 1.0, "MASE_median": 1.0, "cost_per_unit": 1.0, "fill_rate": 1.0, "n_series": 2},
           "per_series": {"s1": {"cost": 1.0, "demand": 2.0, "MASE": 0.5}, "s2": {"cost": 3.0, "demand": 4.0, "MASE": 1.5}}}
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "d__m__r.json").write_text(json.dumps(doc, indent=2))
    rows = read_results(spark, str(tmp_path / "res")).collect()
    assert sorted((r.sid, r.cost) for r in rows) == [("s1", 1.0), ("s2", 3.0)]


def test_sinks(spark, tmp_path):
    from shelfcast.sources.sinks import append_forecasts, append_sales, cached_table, write_cells
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    append_sales(df, str(tmp_path / "s"))
    append_sales(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    append_forecasts(df, str(tmp_path / "f"), run_date="2024-02-01")
    assert spark.read.parquet(str(tmp_path / "f")).select("forecasted_at").first()[0] == dt.date(2024, 2, 1)
    calls = []
    t = cached_table(spark, str(tmp_path / "c"), lambda: calls.append(1) or df)
    t2 = cached_table(spark, str(tmp_path / "c"), lambda: calls.append(1) or df)
    assert t.count() == t2.count() == 1 and len(calls) == 1
    cells = spark.createDataFrame([("d", "m", "r", 1.0), ("d", "m", "q", 2.0)], "dataset string, model string, regime string, x double")
    write_cells(cells, str(tmp_path / "cells"))
    write_cells(spark.createDataFrame([("d", "m", "r", 5.0)], cells.schema), str(tmp_path / "cells"))
    got = {(r.regime, r.x) for r in spark.read.parquet(str(tmp_path / "cells")).collect()}
    assert got == {("r", 5.0), ("q", 2.0)}


def test_strict_lookup_and_geo_round_trip(spark):
    from shelfcast.functions.columns import compose_geolocation, parse_geolocation
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, id int")
    ok = D.strict_lookup(spark.createDataFrame([("a",)], "name string"), dim, ["name"], "id")
    assert ok.first().id == 1
    with pytest.raises(Exception, match="ambiguous"):
        D.strict_lookup(spark.createDataFrame([("b",)], "name string"), dim, ["name"], "id").collect()
    with pytest.raises(Exception, match="missing"):
        D.strict_lookup(spark.createDataFrame([("z",)], "name string"), dim, ["name"], "id").collect()
    g = spark.createDataFrame([(33.8938, 35.5018)], "lat double, lon double")
    back = g.select(parse_geolocation(compose_geolocation("lat", "lon")).alias("p")).first().p
    assert (back.lat, back.lon) == (33.8938, 35.5018)


def test_nested_plan_json(spark):
    from shelfcast.plans.orders import nested_plan
    plan = spark.createDataFrame([("s1", "i2", 3), ("s1", "i1", 4), ("s2", "i1", 1)],
                                 "store_id string, item_id string, forecasted_sold long")
    got = {r.store_id: json.loads(r.json) for r in nested_plan(plan).collect()}
    assert got == {"s1": {"i1": 4, "i2": 3}, "s2": {"i1": 1}}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
