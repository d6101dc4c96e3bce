"""An inbox of extraction payloads as a stream: each new JSON file's documents go through the batch engine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import PAYLOAD, build

SCHEMA = f"doc_id string, po {PAYLOAD}"


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, book: Mapping) -> StreamingQuery:
    """Rows of documents that arrive in `inbox` (JSON lines of doc_id and po) as Parquet in `out`; ends when what is there is done.

    Rows of one document must arrive in one file, as checks look at whole documents.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        build(batch, book).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(SCHEMA).json(inbox)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
