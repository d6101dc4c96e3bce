"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010).

Minima of many hash functions over a document's word shingles give band keys, which bring candidates together; of each minimum only
the low b bits are kept, packed in bytes. Candidates are weighed by the share of agreeing bytes, corrected for chance agreement
(2 ** -b), and those that may reach the threshold are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, written
from .linking import crowded, grouped, joined_keys
from .tokens import LOWER, U64, distinct_in, mixed, pieces, slices

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 28, 5
BITS = 8
#: A pair at 80 % has an estimate below this with a probability under 1e-6 (a binomial of 140 minima).
LEAST_ESTIMATE = 0.6

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, minima array<int>, bands array<long>"


def shingle_sets(part, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text of a slice, as sorted (text, hash); a shorter text is one shingle as a whole."""
    first, window = part.windows(k)
    short = np.flatnonzero((part.count > 0) & (part.count < k))
    whole = np.zeros(len(short), dtype=U64)
    for i in range(k - 1):
        has = part.count[short] > i
        whole[has] = whole[has] * U64(0x100000001B3) + part.hash[part.first[short][has] + i]
    whole = mixed(whole ^ mixed(part.count[short].astype(U64) + U64(1)))
    return distinct_in(np.concatenate([part.doc[first], short]), np.concatenate([window, whole]))


def _sketch(k: int, bands: int, rows: int):
    n = bands * rows
    xor, times = mixed(np.arange(1, n + 1, dtype=U64)), mixed(np.arange(n + 1, 2 * n + 1, dtype=U64)) | U64(1)
    seeds = mixed(np.arange(7, 7 + bands, dtype=U64) * U64(0xD6E8FEB86659FD93))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids = batch.column(0)
            for part in slices(batch.column(1).to_pylist(), fold=LOWER):
                doc, value = shingle_sets(part, k)
                count = np.bincount(doc, minlength=part.texts)
                some = np.flatnonzero(count)
                edge = (np.cumsum(count) - count)[some]
                set_a, set_b = np.zeros(part.texts, dtype=U64), np.zeros(part.texts, dtype=U64)
                minima = np.zeros((len(some), n), dtype=U64)
                if len(some):
                    set_a[some] = np.add.reduceat(mixed(value), edge)
                    set_b[some] = np.add.reduceat(mixed(value ^ U64(0x5851F42D4C957F2D)), edge)
                    for i in range(n):
                        minima[:, i] = np.minimum.reduceat((value ^ xor[i]) * times[i], edge)
                keys = np.zeros((len(some), bands), dtype=U64) + seeds
                for i in range(rows):
                    keys = mixed(keys * U64(0x100000001B3) + minima.reshape(len(some), bands, rows)[:, :, i])
                low = (mixed(minima) & U64(2**BITS - 1)).astype(np.uint8)
                packed: list[np.ndarray | None] = [None] * part.texts
                lists: list[np.ndarray | None] = [None] * part.texts
                for i, d in enumerate(some.tolist()):
                    packed[d], lists[d] = low[i].view(np.int32), keys[i].view(np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(part.at, part.texts),
                        "n_shingles": pa.array(count, pa.int64()),
                        "set_a": pa.array(set_a.view(np.int64)),
                        "set_b": pa.array(set_b.view(np.int64)),
                        "minima": pa.array(packed, pa.list_(pa.int32())),
                        "bands": pa.array(lists, pa.list_(pa.int64())),
                    }
                )

    return sketch


def _confirm(k: int, percent: int):
    """Keeps the pairs whose full shingle sets are alike: 100 * intersection >= percent * union."""

    def sets(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for part in slices(texts, fold=LOWER):
            yield part.at, part.texts, *shingle_sets(part, k)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(2).to_pylist() + batch.column(3).to_pylist()
            step = max(1, int(n * (4 << 20) / (1 + sum(len(x or "") for x in texts))))
            for at in range(0, n, step):
                rows = min(step, n - at)
                pair = texts[at : at + rows] + texts[n + at : n + at + rows]
                size, both = np.zeros(2 * rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
                parts = [(d + at0, v) for at0, _, d, v in sets(pair)]
                doc, value = np.concatenate([d for d, _ in parts]), np.concatenate([v for _, v in parts])
                size = np.bincount(doc, minlength=2 * rows)
                row = doc % rows
                order = np.lexsort((value, row))
                same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
                both = np.bincount(row[order][1:][same], minlength=rows)
                union = size[:rows] + size[rows:] - both
                alike = (union > 0) & (100 * both >= percent * union)
                yield batch.slice(at, rows).select([0, 1]).filter(pa.array(alike))

    return confirm


def _shingles(k: int):
    """(item, n, shingles): the size of each text's shingle set, and the set."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for part in slices(batch.column(1).to_pylist(), fold=LOWER):
                doc, value = shingle_sets(part, k)
                edges = np.searchsorted(doc, np.arange(part.texts + 1))
                lists = [value[lo:hi].view(np.int64) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.record_batch({"item": batch.column(0).slice(part.at, part.texts), "n": pa.array(np.diff(edges)), "shingles": pa.array(lists, pa.list_(pa.int64()))})

    return shingles


def rare_buckets(items: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(item, bucket, n, rest): the shingles of each item under which it must meet any item that it is linked with; the size of its set, and how many of
    its shingles are no rarer than this one and not its alone.

    A set of n shingles has more than n - percent / 100 * n in common with such an item, so that the two share one of the n - ceil(percent * n / 100) + 1
    rarest of either. Those that no other item has come first, as the rarest of all, and are no buckets: an item with more of its own is linked with none.
    """
    sets = written(attach(texts, items.withColumnRenamed("item", "doc_id"), ["doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(_shingles(shingle), "item long, n long, shingles array<long>"))
    rows = sets.select("item", "n", F.explode("shingles").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "bucket").groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("often", "bucket"))).alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    first = shared.filter(prefix > 0).select("item", "n", F.size("shared").alias("all"), F.posexplode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("at", "x"))
    return first.select("item", "x.bucket", "n", (F.col("all") - F.col("at")).alias("rest"))


def may_link(percent: int):
    """Whether two items of a bucket of rare_buckets() can be linked with this as their rarest common shingle, by what of both sets is no rarer."""
    return lambda x, y: F.least(x["rest"], y["rest"]) * (100 + percent) >= (x["n"] + y["n"]) * percent


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by likeness of their word shingles: doc_id, n_shingles, component_id (long), kept (boolean).

    Each row of docs gives one row. component_id is the smallest doc_id reachable, and kept says whether it is the row's own. A-Z count
    as lower case. A text of fewer words than a shingle is one shingle as a whole; texts that are null or have no word are linked with
    nothing. Rows that repeat a doc_id share the smallest group of any of them. A null doc_id has n_shingles alone, and is
    kept. Other columns are ignored. Pairs at the threshold share no band with a probability under 2e-5.
    """
    base = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(shingle, bands, rows), SKETCH))
    some = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class; its smallest document stands for it.
    keys = ["n_shingles", "set_a", "set_b"]
    classes = some.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    member = written(some.select("doc_id", *keys).join(classes, keys).select("doc_id", "rep").distinct())
    reps = written(member.filter("doc_id = rep").join(some.select("doc_id", "minima", "bands"), "doc_id").dropDuplicates(["doc_id"]).drop("rep"))

    shared = written(crowded(reps.select(F.col("doc_id").alias("item"), "bands"), F.array_distinct("bands")))
    # What candidates need is kept once, so that pairs meet small tables.
    near = shared.select(F.col("item").alias("doc_id")).distinct()
    minima = written(reps.join(near, "doc_id").select("doc_id", "minima", "bands"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        a = minima.select(F.col("doc_id").alias("a"), F.col("minima").alias("_a"))
        b = minima.select(F.col("doc_id").alias("b"), F.col("minima").alias("_b"))
        chance, n = 2.0**-BITS, bands * rows
        agree = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + equal_bytes(x))
        likely = written(pairs.join(a, "a").join(b, "b").filter((agree / n - chance) / (1 - chance) >= LEAST_ESTIMATE).select("a", "b"))
        wanted = written(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct())
        found = written(attach(texts, wanted, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]))
        a = found.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = found.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return likely.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent), "a long, b long")

    items = minima.select(F.col("doc_id").alias("item"), F.col("bands").alias("keys"))
    groups = grouped(items, shared, [joined_keys(2), joined_keys(3)], verify, last=lambda some: rare_buckets(some, texts, shingle, percent), worth=may_link(percent))
    least = member.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = base.select("doc_id", "n_shingles").join(least, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def equal_bytes(x: Column) -> Column:
    """The number of zero bytes in a 32-bit number (the exclusive or of two packs of four minima)."""
    low, x = F.lit(0x7F7F7F7F).cast("long"), x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lit(4) - F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(F.lit(0x80808080)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one document of each group, with their columns as they were, of any name. Rows that repeat a doc_id
    stay or go together; those with a null doc_id stay."""
    row_id = fresh(docs, "row_id")
    gone = written(near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias(row_id)).distinct())
    rows = docs.withColumn(row_id, F.col("doc_id").cast("long"))
    return attach(rows, gone, [row_id], "left_anti").select(*(f"`{c}`" for c in docs.columns))
