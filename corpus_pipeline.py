"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, source mixing, BPE encoding.

Each stage reads what its predecessor kept, as Parquet in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from shelfcast.llm.queries import VOCABULARY
from shelfcast.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. The row travels as one struct, so columns of the
    documents never clash with those of the rules."""
    judged = quality.quality_rules(docs.select(F.struct(*docs.columns).alias("__row"), "text"))
    return judged.filter("kept").select("__row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the largest id) of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens and the digests of its ids and of the text decoded from them."""
    return bpe.encode_digests(docs, VOCABULARY)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("mixing sources", mix_stage), ("BPE encoding", encode_stage)]

#: SQL can express neither the drawing of shards nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}/{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
