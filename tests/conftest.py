import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("shelfcast-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shelfcast-test-ckpt-"))
    yield s


@pytest.fixture
def make_panel(spark):
    """{sid: [y, ...]} → long panel (sid, wk, week_start, y); None = missing."""
    def build(series: dict):
        rows = [(sid, wk, dt.date(1995, 1, 1) + dt.timedelta(days=7 * wk), None if v is None else float(v))
                for sid, ys in series.items() for wk, v in enumerate(ys)]
        return spark.createDataFrame(rows, "sid string, wk int, week_start date, y double")
    return build
