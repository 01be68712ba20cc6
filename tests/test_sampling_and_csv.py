"""P12 sampling (G16 error when too few eligible; deterministic md5 draw) and the K5 CSV sink."""

import datetime as dt

import pytest

from shelfcast.operators.panel import sample_series


def test_sampling_is_deterministic_and_strict(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(50)], "sid string")
    a = [r.sid for r in sample_series(ids, 10, 51).collect()]
    b = [r.sid for r in sample_series(ids, 10, 51).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 10
    assert sorted(a) != sorted(r.sid for r in sample_series(ids, 10, 7).collect())
    with pytest.raises(ValueError, match="only 50 eligible"):
        sample_series(ids, 51, 51)


def test_csv_table_sink(spark, tmp_path):
    from shelfcast.sources.sinks import write_csv_table
    df = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.25)], "dataset string, model string, p double")
    write_csv_table(df, str(tmp_path / "sig"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sig"))
    assert back.count() == 2 and back.columns == ["dataset", "model", "p"]
    assert len([p for p in (tmp_path / "sig").iterdir() if p.name.endswith(".csv")]) == 1


def test_wide_csv_by_arrays(spark, tmp_path):
    from shelfcast.operators.panel import days_by_series, unpivot_days
    from shelfcast.sources.files import read_wide_csv
    from shelfcast.sources.sinks import write_wide_csv
    rows = [("1", "a,b", 3, dt.date(1995, 1, 3)), ("1", "a,b", 2, dt.date(1995, 1, 3)), ("2", 's"x', 5, dt.date(1995, 1, 5)),
            ("2", 's"x', 9, dt.date(1995, 1, 9)), ("3", "t", 1, None)]
    sales = spark.createDataFrame(rows, "item_id string, store_id string, sold int, date date")
    write_wide_csv(days_by_series(sales, dt.date(1995, 1, 1), 7), str(tmp_path / "w"), 7)  # starts before the first sale, ends before the last
    long = unpivot_days(read_wide_csv(spark, str(tmp_path / "w")))
    assert "Expand" not in long._jdf.queryExecution().toString()
    got = {(r.id, r.day): r.y for r in long.collect()}
    assert len(got) == 14 and {k: v for k, v in got.items() if v} == {("a,b_1", 3): 5.0, ('s"x_2', 5): 5.0}
    gaps = spark.createDataFrame([("i", 1.0, 2.0, None)], "id string, d_2 double, d_10 double, d_x double")
    assert sorted(map(tuple, unpivot_days(gaps).select("day", "y").collect()), key=str) == [(10, 2.0), (2, 1.0), (None, None)]


def test_cached_panel_scan(spark, make_panel, tmp_path):
    from shelfcast.sources.files import read_panel
    panel = make_panel({"a": [1, None, 3]})
    panel.write.parquet(str(tmp_path / "panel"))
    back = read_panel(spark, str(tmp_path / "panel"))
    assert back.schema == panel.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, panel.collect()))
