"""Sharding by minimax contiguous partition.

Rows with equal texts are an atomic group. Groups stand in the order of their text's hash, in cells of that order; cells are the atoms
that are cut. The smallest shard capacity for which a greedy pass over the cell sizes needs no more than the wanted shards is found by
binary search, and the cells are cut there. A cell above a fair share of what is left comes first in the order, as a shard of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_rank, written

SHARDS = 16
CELLS = 1 << 16


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which contiguous shards hold all sizes (non-negative whole numbers)."""
    ends = np.cumsum(sizes)
    low, high = int(sizes.max(initial=0)), int(ends[-1]) if len(ends) else 0
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ends, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def greedy_cuts(ends: np.ndarray, capacity: int) -> list[int]:
    """The end (exclusive) of each shard, filled as far as the capacity allows. ends: running sums of the sizes."""
    cuts, done = [], 0
    while not cuts or cuts[-1] < len(ends):
        cuts.append(int(np.searchsorted(ends, done + capacity, side="right")))
        done = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The end (exclusive) of each contiguous shard under the smallest capacity. Within that capacity, a shard ends near a fair share of
    what is left, if the rest still fits."""
    capacity, ends, cuts, done = smallest_capacity(sizes, shards), np.cumsum(sizes), [], 0
    for left in range(shards, 1, -1):
        at = cuts[-1] if cuts else 0
        most = int(np.searchsorted(ends, done + capacity, side="right"))
        fair = int(np.searchsorted(ends, done + (int(ends[-1]) - done) / left)) + 1
        cut = max(at, min(fair, most))
        done_then = int(ends[cut - 1]) if cut else 0
        if len(greedy_cuts(ends[cut:] - done_then, capacity)) > left - 1:
            cut, done_then = most, int(ends[most - 1]) if most else 0
        cuts.append(cut)
        done = done_then
    return [*cuts, len(sizes)]


def plan(sizes: np.ndarray, shards: int) -> tuple[list[int], list[int]]:
    """Cells that each fill a shard alone, being over a fair share of what is left, and the first cells of the other shards."""
    alone: list[int] = []
    rest = sizes.copy()
    while len(alone) < shards - 1 and rest.max(initial=0) * (shards - len(alone)) > rest.sum():
        alone.append(int(rest.argmax()))
        rest[alone[-1]] = 0
    return alone, [0, *minimax_cuts(rest, shards - len(alone))[:-1]]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32 (long), law (`bytes`), shard (int), slot (long, gapless from 0 in each shard), grown_shard (int, null).

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty, and is of one group with empty ones. One row out for each row
    in, null and repeated doc_ids included: rows that are equal in id and text may swap slots. An empty table has no shards. A
    group over a shard's fair share stays whole. The driver holds the sizes of 65,536 cells, no more,
    however many groups there are. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    rows = written(rows.withColumn("_cell", F.shiftrightunsigned("_hash", 48).cast("int")))
    sizes = np.zeros(CELLS, dtype=np.int64)
    for r in rows.groupBy("_cell").agg(F.sum("size").alias("size")).collect():
        sizes[r["_cell"]] = r["size"]
    alone, starts = plan(sizes, shards)
    number = F.expr(" + ".join([str(len(alone)), *(f"cast(_cell >= {x} as int)" for x in starts[1:])]))
    for i, cell in enumerate(alone):
        number = F.when(F.col("_cell") == cell, i).otherwise(number)
    placed = rows.withColumn("shard", number)
    ranked = with_rank(placed, "shard", [F.col("_hash"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32")], "slot", cell=F.col("_cell").cast("long") * 1024 + F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
