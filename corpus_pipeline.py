"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing. One stage feeds the next through Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, near_dedup, packing, quality
from millrace.llm.common import documents, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and compression bands accept."""
    return quality.keep_quality(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, less the lines that another occurrence stands for; n_chars follows the text."""
    out = line_dedup.deduplicate_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; n_chars follows the text."""
    return mixing.mix_rows(docs).withColumn("n_chars", F.length("text").cast("long"))


def batch_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each piece of what the mix took."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("packing", batch_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each one's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
