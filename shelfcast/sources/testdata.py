"""Adapters from the driver's TPC-H-style tables to the sales fact this engine works on.

``sales(item_id, store_id, sold, date)`` =
lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region with item = brand and store = region (or nation).
Only nation and region are broadcast explicitly: their sizes are fixed by the schema (25 and 5
rows). part and supplier grow with the scale factor, so their join strategy is left to AQE,
which broadcasts them only when their measured runtime size is under the threshold and falls
back to a shuffle join (with skew splitting) otherwise. Supplier joins as it is scanned, so that its size is known;
its geography follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.columns import signed_quantity, to_day

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class TableSource:
    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def geography(src: TableSource, level: str = "region") -> DataFrame:
    """nation_key → store_id (the name of the region or nation), region_key: 25 rows by schema."""
    nation = src.nation.select("n_nationkey", "n_name", "n_regionkey")
    region = src.region.select("r_regionkey", "r_name")
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_nationkey").alias("nation_key"), F.col("r_name" if level == "region" else "n_name").alias("store_id"),
                    F.col("r_regionkey").alias("region_key")))


def sales_view(src: TableSource, level: str = "region", signed: bool = False,
               with_keys: bool = False) -> DataFrame:
    """The sales fact: item_id (brand), store_id (region or nation name), sold, date.

    ``signed=True`` makes returned lines negative (the returns view used by F11).
    ``with_keys=True`` keeps nation_key/region_key for tenant filters.
    """
    li = src.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    part = src.part.select("p_partkey", "p_brand")
    supplier = src.supplier.select("s_suppkey", "s_nationkey")
    geo = geography(src, level)
    sold = signed_quantity("l_quantity", "l_returnflag") if signed else F.col("l_quantity")
    df = (li.join(part, li.l_partkey == part.p_partkey)
            .join(supplier, li.l_suppkey == supplier.s_suppkey).join(F.broadcast(geo), supplier.s_nationkey == geo.nation_key))
    cols = [F.col("p_brand").alias("item_id"), F.col("store_id"), sold.alias("sold"),
            to_day("l_shipdate").alias("date")]
    if with_keys:
        cols += [F.col("nation_key"), F.col("region_key")]
    return df.select(*cols)
