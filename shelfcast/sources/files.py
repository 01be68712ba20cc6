"""File scans (S1–S4, S6) with explicit schemas; no schema inference on large inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_CSV_SCHEMA = "item_id string, store_id string, sold int, date date"
LONG_CSV_COLUMNS = ("date", "store_nbr", "item_nbr", "unit_sales")


def read_sales_csv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The upload CSV (item_id, store_id, sold, date); ids are kept as text."""
    return (spark.read.schema(SALES_CSV_SCHEMA).option("header", True).option("mode", mode)
                 .option("dateFormat", "yyyy-MM-dd").csv(path))


def read_wide_csv(spark: SparkSession, path: str, id_col: str = "id", prefix: str = "d_") -> DataFrame:
    """Wide daily CSV: the id column plus every ``d_<n>`` column from ``d_1`` on.

    The header is read once to build the schema (ids as text, day columns as double), so the
    data pass itself does no inference.
    """
    header = spark.read.option("header", True).csv(path).columns
    start = header.index(f"{prefix}1") if f"{prefix}1" in header else len(header)
    days = [c for c in header[start:] if c.startswith(prefix)]
    ddl = ", ".join(f"`{c}` {'double' if c in days else 'string'}" for c in header)
    df = spark.read.schema(ddl).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(id_col, *days)


def read_long_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: long daily CSV; reads the 4 needed columns (column pruning at the scan)."""
    ddl = schema or "id long, date date, store_nbr short, item_nbr int, unit_sales double, onpromotion boolean"
    df = spark.read.schema(ddl).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*LONG_CSV_COLUMNS)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A cached long panel (sid, wk, week_start, y)."""
    return spark.read.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result cells written as JSON documents (one per cell); ``per_series`` map exploded
    into rows (dataset, model, regime, sid, cost, demand, MASE)."""
    schema = ("dataset string, model string, regime string, params string, seconds double, "
              "summary struct<MASE:double, MASE_median:double, cost_per_unit:double, fill_rate:double, "
              "n_series:long>, per_series map<string, struct<cost:double, demand:double, MASE:double>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select("dataset", "model", "regime", F.explode("per_series").alias("sid", "s")) \
               .select("dataset", "model", "regime", "sid", "s.cost", "s.demand", "s.MASE")
