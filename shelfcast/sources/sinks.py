"""Sinks (K1–K6). Writes are plain DataFrame writers; partition layout is chosen for the reads
that follow (forecast history by run date, results by cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import path_exists


def append_sales(sales: DataFrame, path: str) -> None:
    """K1: bulk append, no de-duplication: loading the same file twice doubles its sales."""
    sales.write.mode("append").parquet(path)


def append_forecasts(forecasts: DataFrame, path: str, run_date=None, by: tuple[str, ...] = ()) -> None:
    """K2: append forecasts stamped with the run date, partitioned by it. With ``by`` (a company) a run that is made
    again replaces its own rows of that date and those of no other."""
    stamp = F.lit(run_date).cast("date") if run_date is not None else F.current_date()
    stamped = forecasts.withColumn("forecasted_at", stamp)
    if by:
        (stamped.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("forecasted_at", *by).parquet(path))
    else:
        stamped.write.mode("append").partitionBy("forecasted_at").parquet(path)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """K3: build-once cache. ``build()`` runs only when nothing is stored at ``path`` yet;
    ``mode=ignore`` keeps a concurrent first writer's copy."""
    if not path_exists(spark, path):
        build().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def write_cells(cells: DataFrame, path: str, partition_cols=("dataset", "model", "regime")) -> None:
    """K4: one result per cell; rewriting a cell replaces only that cell's partition."""
    (cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy(*partition_cols).parquet(path))


def write_csv_table(df: DataFrame, path: str) -> None:
    """K5: a small report table as one headed CSV file (report tables are cell-sized)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_wide_csv(series: DataFrame, path: str, n_days: int, prefix: str = "d_") -> None:
    """The wide daily CSV that S2 reads, from one array of ``n_days`` values per series (id, days): a line per series,
    without a pivot."""
    series.select("id", *[F.get("days", F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(n_days)]).write.option("header", True).csv(path)


def plan_json(nested: DataFrame) -> DataFrame:
    """K6: per store JSON text of its {item: quantity} map."""
    return nested.select("store_id", F.to_json("items").alias("json"))
