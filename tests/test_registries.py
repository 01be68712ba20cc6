"""Registries (M5, M8, M9), failure capture (T6), timing (T5), long CSV scan (S3), upload CSV."""

import pytest

from shelfcast.operators.bootstrap import METRIC_REGISTRY
from shelfcast.plans.experiment import DATASETS, load_dataset, run_cells, timed
from shelfcast.plans.forecasters import FORECASTERS, GRIDS, get_forecaster
from tests.conftest import SF001


def test_registries():
    assert set(FORECASTERS) >= {"seasonal_naive", "moving_average", "quantile_forest"}
    assert [g["window"] for g in GRIDS["moving_average"]] == [2, 4, 6, 8, 13, 26, 52]
    with pytest.raises(KeyError):
        get_forecaster("nope")
    assert set(METRIC_REGISTRY) == {"MASE", "MASE_median", "cost_per_unit"}
    assert set(DATASETS) == {"brand_region", "brand_nation"}


def test_dataset_loader(spark):
    st = load_dataset("brand_region", spark, SF001)
    assert st.name == "brand_region" and st.levels == (0.5, 0.8)


def test_failing_cell_is_reported_and_skipped(spark):
    def boom():
        raise RuntimeError("cell failed")
    results, failures = run_cells(spark, [("ok", lambda: 1), ("bad", boom), ("ok2", lambda: 2)])
    assert [r[0] for r in results] == ["ok", "ok2"]
    assert [(r.cell, r.error) for r in failures.collect()] == [("bad", "RuntimeError")]
    out, secs = timed(lambda: sum(range(10)))
    assert out == 45 and secs >= 0


def test_csv_scans(spark, tmp_path):
    from shelfcast.sources.files import read_long_csv, read_sales_csv
    p = tmp_path / "long.csv"
    p.write_text("id,date,store_nbr,item_nbr,unit_sales,onpromotion\n1,2013-01-02,3,105,-2.0,false\n"
                 "2,2013-01-03,3,105,5.5,true\n")
    df = read_long_csv(spark, str(p))
    assert df.columns == ["date", "store_nbr", "item_nbr", "unit_sales"]
    assert df.count() == 2
    u = tmp_path / "up.csv"
    u.write_text("item_id,store_id,sold,date\n10,20,3,2024-01-01\n")
    row = read_sales_csv(spark, str(u)).first()
    assert (row.item_id, row.store_id, row.sold) == ("10", "20", 3)
