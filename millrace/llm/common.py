"""Shared tables, size-checked broadcasts and distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int = 16) -> DataFrame:
    """Joins a written table to a wide one. The table is broadcast if its counted rows take BROADCAST_BYTES at most;
    beyond that both sides are shuffled."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def with_rank(df: DataFrame, group: str, order: list[Column], name: str, cell: Column | None = None) -> DataFrame:
    """Adds the 0-based rank of each row within its group, in cells: no task holds a whole group.

    cell: an integer that is monotone in the order within the group; rows of one cell are sorted in one task. Without it, rows are
    dealt to 1,024 cells by their hash, and the rank follows (hash cell, order).
    """
    from pyspark.sql import Window

    cell = F.pmod(F.xxhash64(*order), F.lit(1024)) if cell is None else cell
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(within))
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_cell").eqNullSafe(F.col("_c")))
        .withColumn(name, F.col("_before") + F.col("_rn") - 1)
        .drop("_cell", "_g", "_c", "_before", "_rn")
    )
