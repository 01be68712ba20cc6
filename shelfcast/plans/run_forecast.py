"""The app's forecast run, for all companies at once: export, forecast, stamped append, plan.

The keyed sales of ``streaming.ingest`` become next month's orders, each company on its own calendar (its first sale
to its last); they are appended to ``forecasts`` by (run date, company), so that a run made again replaces only
itself; the plan is read back from there with the names of stores and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import dims as D
from shelfcast.plans.orders import aggregate_plan, next_month_forecast
from shelfcast.sources.sinks import append_forecasts
from shelfcast.streaming.ingest import DIM_SCHEMA

BY = ["company_id"]


def run_forecast(spark: SparkSession, tables: str, run_date, companies: list[int] | None = None) -> DataFrame:
    """Forecasts of ``companies`` (all, unless given) are appended for
    ``run_date``; returns their plan (company_id, store_id, item_id, forecasted_sold), zeros removed. A key that a
    dimension lacks raises."""
    sales = spark.read.parquet(f"{tables}/sales")
    wanted = F.col("company_id").isin(companies) if companies is not None else F.lit(True)
    rows = sales.filter(wanted).select(*BY, F.col("store_key").alias("store_id"), F.col("item_key").alias("item_id"), "sold", "date")
    forecast = next_month_forecast(rows, by=BY).withColumnsRenamed({"store_id": "store_key", "item_id": "item_key"})
    append_forecasts(forecast, f"{tables}/forecasts", run_date, by=tuple(BY))
    return company_plan(spark, tables, run_date).filter(wanted)


def company_plan(spark: SparkSession, tables: str, run_date) -> DataFrame:
    """The plan of a run: its forecasts of the date, summed by store and item, with their names."""
    schema = "store_key long, item_key long, forecasted_date date, forecasted_sold long, forecasted_at date, company_id long"
    run = spark.read.schema(schema).parquet(f"{tables}/forecasts").filter(F.col("forecasted_at") == F.lit(run_date).cast("date"))
    plan = aggregate_plan(run.withColumnsRenamed({"store_key": "store_id", "item_key": "item_id"}), by=BY)
    for kind, key in (("stores", "store_id"), ("products", "item_id")):
        dim = spark.read.schema(DIM_SCHEMA).parquet(f"{tables}/{kind}").select(*BY, F.col("id").alias(key), "name")
        plan = D.strict_lookup(plan, dim, [*BY, key], "name").drop(key).withColumnRenamed("name", key)
    return plan.select(*BY, "store_id", "item_id", "forecasted_sold")
