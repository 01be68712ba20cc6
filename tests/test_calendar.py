"""The weekly calendar spans the sales of the table: none before or after the given tables' dates is lost."""

import os

import duckdb
import pytest

from shelfcast.config import TESTDATA_SPEC
from shelfcast.plans.experiment import Study
from tests.conftest import SF001


@pytest.fixture(scope="module")
def longer(tmp_path_factory):
    """sf0.001 with one sale in 1994 and, as the last, one on a Saturday of 2003: whole weeks only."""
    root = tmp_path_factory.mktemp("longer")
    for t in ("part", "supplier", "nation", "region"):
        os.symlink(f"{SF001}/{t}.parquet", root / f"{t}.parquet")
    one = "SELECT * REPLACE ({q} AS l_quantity, TIMESTAMP '{d}' AS l_shipdate) FROM (SELECT * FROM l LIMIT 1)"
    duckdb.execute(f"COPY (WITH l AS (FROM '{SF001}/lineitem.parquet') FROM l UNION ALL {one.format(q=1000, d='1994-03-02')} "
               f"UNION ALL {one.format(q=5000, d='2003-05-10')}) TO '{root}/lineitem.parquet' (FORMAT parquet)")
    return str(root)


def test_no_sale_is_lost(spark, longer):
    import __spark_entry__ as E
    units = duckdb.sql(f"SELECT sum(l_quantity) FROM '{longer}/lineitem.parquet'").fetchall()[0][0]
    for name in ("weekly_panel", "wide_to_weekly"):
        r = E.queries()[name](spark, longer).selectExpr("sum(y)", "min(week_start)", "max(week_start)", "max(wk) + 1").first()
        assert r[0] == pytest.approx(float(units)) and (str(r[1]), str(r[2]), r[3]) == ("1994-02-27", "2003-05-04", 480)


def test_given_tables_keep_their_calendar(spark):
    assert Study(spark, SF001, "region").spec == Study(spark, SF001, "nation").spec == TESTDATA_SPEC
