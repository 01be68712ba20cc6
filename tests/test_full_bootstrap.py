"""The significance queries run the protocol's 10,000 resamples (T10–T13): against DuckDB, replicate by replicate."""

import duckdb
import pytest

from shelfcast.config import N_RESAMPLES
from shelfcast.plans import oracle as O
from tests.conftest import SF01

PLANNED = ("a.model = 'moving_average' AND a.metric = 'cost_per_unit' AND ((a.regime = 'fine_tune' AND b.regime = 'zero_shot') "
           "OR b.model = 'seasonal_naive')")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_planned_contrasts_use_all_resamples(spark, con):
    import __spark_entry__ as E
    sql = (f"WITH {O.experiment('region', 'brand_region', '')},\n{O.bootstrap('cellps', N_RESAMPLES)},\n"
           f"{O.pair_tests(pair_filter=PLANNED)} SELECT model_a || ' ' || regime_a, model_b || ' ' || regime_b, "
           "CASE WHEN p_value < 0.001 THEN '<0.001' ELSE printf('%.3f', p_value) END FROM bs_res")
    got = {(r.label_a, r.label_b, r.p) for r in E.queries()["planned_contrasts"](spark, SF01).collect()}
    assert got == set(con.execute(sql).fetchall()) and len(got) == 3


def test_all_pairs_use_all_resamples(spark, con):
    import __spark_entry__ as E
    sql = (f"WITH {O.experiment('region', 'brand_region', '')},\n{O.config_cells('', 'brand_region')},\n"
           f"{O.bootstrap('cfgps', N_RESAMPLES)},\n{O.pair_tests()} SELECT regime_a, regime_b, metric, round(p_value, 6) FROM bs_res")
    got = {(r.regime_a, r.regime_b, r.metric): r.p_value for r in E.queries()["bootstrap_pairs"](spark, SF01).collect()}
    want = {tuple(r[:3]): r[3] for r in con.execute(sql).fetchall()}
    assert got.keys() == want.keys() and len(got) == 84
    assert got == pytest.approx(want, abs=1e-6)
    assert any(p * N_RESAMPLES / 2 % 50 for p in got.values())   # finer than 200 resamples can tell
