"""Repeated uploads as a stream (S7): every new CSV file in a landing folder is one upload.

``readStream`` (file source, explicit schema) → ``foreachBatch`` that, per micro-batch,
inserts unseen stores and products with surrogate ids (R1, R2) and adds the rows, by those ids (R3), to the
sales table (K1 — no de-duplication of uploads, like the batch upload); rows without a quantity, with a negative
one, or without an item or a store go to a table of rejects (F9). ``trigger(availableNow=True)`` drains everything present and stops.
``foreachBatch`` runs a batch again after a failure, so a stream's rows lie in one partition per
batch of the query (``upload``), which a second run replaces: its sales count once. Appending needs no watermark: there
is no state across batches other than the dimension tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import dims as D
from shelfcast.session import path_exists
from shelfcast.sources.files import SALES_CSV_SCHEMA


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows while it is not there; any other error is the caller's."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


DIM_SCHEMA = "id long, company_id long, name string"
DIMS = (("products", "item_id", "item_key"), ("stores", "store_id", "store_key"))


def apply_upload(batch: DataFrame, company_id: int, tables: str, upload: str | None = None) -> None:
    """One upload, of a batch or a stream: dimension insert-if-absent with new ids, then good rows, by their keys, to
    ``sales`` and the others, by their names, to ``rejects``. Uploads with the same name replace each other; without a
    name each is an upload of its own. One upload at a time writes to ``tables``."""
    spark = batch.sparkSession
    whole = batch.withColumn("company_id", F.lit(company_id).cast("long")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        named = F.col("item_id").isNotNull() & F.col("store_id").isNotNull()
        good, bad = whole.filter(D.is_good("sold") & named), whole.filter(~(D.is_good("sold") & named))
        for kind, name, _ in DIMS:
            insert_new(spark, good, name, f"{tables}/{kind}")
        _write_upload(keyed(spark, good, tables), f"{tables}/sales", upload := upload or uuid.uuid4().hex)
        _write_upload(bad.select("company_id", "store_id", "item_id", "sold", "date"), f"{tables}/rejects", upload)
    finally:
        whole.unpersist()


def insert_new(spark: SparkSession, rows: DataFrame, name: str, path: str) -> None:
    """R1 + R2: the names of ``rows`` that the dimension lacks get the ids behind its greatest. Names that an earlier
    run of the same upload has put there keep theirs, so a run repeated adds nothing."""
    dim = _read_or_empty(spark, path, DIM_SCHEMA)
    names = D.distinct_keys(rows, name, ["company_id"]).withColumnRenamed(name, "name")
    new = names.join(dim, ["company_id", "name"], "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        after = dim.agg(F.max("id")).first()[0] or 0
        D.assign_keys(new, ["company_id", "name"], after).write.mode("append").parquet(path)
    finally:
        new.unpersist()


def keyed(spark: SparkSession, rows: DataFrame, tables: str) -> DataFrame:
    """(company_id, store_key, item_key, sold, date); a name without a key, or with two, raises."""
    for kind, name, key in DIMS:
        dim = _read_or_empty(spark, f"{tables}/{kind}", DIM_SCHEMA).select("company_id", F.col("name").alias(name), F.col("id").alias(key))
        rows = D.strict_lookup(rows, dim, ["company_id", name], key)
    return rows.select("company_id", "store_key", "item_key", "sold", "date")


def named_sales(spark: SparkSession, tables: str) -> DataFrame:
    """The sales table with its names: company_id, store_id, item_id, sold, date, upload."""
    rows = spark.read.parquet(f"{tables}/sales")
    for kind, name, key in DIMS:
        dim = spark.read.schema(DIM_SCHEMA).parquet(f"{tables}/{kind}")
        rows = rows.join(dim.select(F.col("name").alias(name), F.col("id").alias(key)), key)
    return rows.select("company_id", "store_id", "item_id", "sold", "date", "upload")


def _write_upload(rows: DataFrame, path: str, upload: str) -> None:
    (rows.withColumn("upload", F.lit(upload)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("upload").parquet(path))


def ingest_stream(spark: SparkSession, landing: str, tables: str, checkpoint: str, company_id: int):
    """Start the availableNow stream over ``landing``; returns the StreamingQuery. An upload is named by the id
    that the checkpoint gives the query and by the batch, so a new checkpoint never replaces older sales."""
    def upload(df: DataFrame, epoch: int) -> None:
        query = df.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        apply_upload(df, company_id, tables, f"{query}-{epoch}")
    src = (spark.readStream.schema(SALES_CSV_SCHEMA).option("header", True)
                .option("maxFilesPerTrigger", 1).csv(landing))
    return (src.writeStream.option("checkpointLocation", checkpoint)
               .foreachBatch(upload)
               .trigger(availableNow=True).start())
