"""Dimension and keyed-update operators of the ordering app.

Dimensions are small per company but not bounded overall, so joins against them are left
to AQE (broadcast when the measured side is small, shuffle join otherwise) unless the
caller knows the side is bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DEFAULT_GEOLOCATION
from shelfcast.functions.columns import parse_geolocation, with_default_location


def distinct_keys(batch: DataFrame, key: str, scope: list[str] | None = None) -> DataFrame:
    """Distinct keys of an upload batch (per company scope)."""
    return batch.select(*(scope or []), key).distinct()


def insert_if_absent(keys: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """R2: new dimension = old ∪ (batch keys not in old); ``is_new`` marks inserted rows."""
    new = keys.join(dim.select(*on), on, "left_anti")
    return (dim.select(*on).withColumn("is_new", F.lit(False))
               .unionByName(new.select(*on).withColumn("is_new", F.lit(True))))


def assign_keys(new: DataFrame, on: list[str], after: int = 0, bucket_rows: int = 1 << 16, id_col: str = "id") -> DataFrame:
    """R2: surrogate ids ``after`` + 1, ... for the distinct keys ``new``, without gaps.

    Keys are dealt by their hash into buckets of about ``bucket_rows``, numbered within the bucket in key order, and
    each bucket gets a block of ids behind those of the buckets before it: no global sort, and what one window holds
    is a bucket, or one row a bucket. The ids follow from the keys alone, so a run repeated gives the same."""
    buckets = max(1, math.ceil(new.count() / bucket_rows))
    placed = new.withColumn("_b", F.pmod(F.xxhash64(*on), F.lit(buckets)))
    blocks = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*on)))
    return ranked.join(blocks, "_b").select((F.col("_before") + F.col("_r") + F.lit(after)).cast("long").alias(id_col), *new.columns)


def first_seen(rows: DataFrame, on: list[str], cutoff, date: str = "date") -> DataFrame:
    """R1 + R2 over a history in one pass: every key with ``is_new``, whether it was first seen at ``cutoff`` or later and
    so is new to the dimension built before. The first date of a key is combined on the map side."""
    first = rows.groupBy(*on).agg(F.min(date).alias("_first"))
    return first.select(*on, (F.col("_first") >= F.lit(cutoff)).alias("is_new"))


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """Natural key → surrogate key by equi-join."""
    return facts.join(dim.select(*on, id_col), on, "inner")


def strict_lookup(facts: DataFrame, dim: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """Like ``lookup`` but a missing or ambiguous key raises at run time (``raise_error``).

    Ambiguity is detected per key by a grouped count on the dimension side, so no key set is
    ever collected to the driver.
    """
    counted = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_k"), F.min(id_col).alias(id_col))
    j = facts.join(counted, on, "left")
    check = (F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("missing key: "),
                                                                  F.concat_ws("/", *[F.col(c).cast("string") for c in on]))))
              .when(F.col("_k") > 1, F.raise_error(F.concat(F.lit("ambiguous key: "),
                                                             F.concat_ws("/", *[F.col(c).cast("string") for c in on]))))
              .otherwise(F.col(id_col)))
    return j.withColumn(id_col, check).drop("_k")


def upsert(current: DataFrame, updates: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Update-or-create by key: full outer join, new values win (a new snapshot)."""
    u = updates.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    j = current.join(u, key, "full_outer")
    return j.select(*key, *[F.coalesce(F.col(f"_new_{v}"), F.col(v)).alias(v) for v in values])


def update_attribute(current: DataFrame, updates: DataFrame, key: list[str], attr: str) -> DataFrame:
    """Set an attribute for matching keys only (left join, update wins)."""
    u = updates.select(*key, F.col(attr).alias("_upd"))
    return (current.join(u, key, "left")
                   .withColumn(attr, F.coalesce(F.col("_upd"), F.col(attr))).drop("_upd"))


def store_locations(stores: DataFrame, default: str = DEFAULT_GEOLOCATION) -> DataFrame:
    """F5 + F6 + F8: name + {lat, lon} parsed from text, model default when unset."""
    geo = parse_geolocation(with_default_location("geolocation", default))
    return stores.select("*", geo.alias("location"))


def is_good(qty: str = "sold"):
    """the non-negative quantity rule (a missing quantity breaks it)."""
    return F.col(qty).isNotNull() & (F.col(qty) >= 0)


def split_quality(sales: DataFrame, qty: str = "sold") -> tuple[DataFrame, DataFrame]:
    """rows that satisfy the non-negative quantity rule, and the rejected rows."""
    return sales.filter(is_good(qty)), sales.filter(~is_good(qty))
