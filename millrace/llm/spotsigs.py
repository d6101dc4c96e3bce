"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008).

A signature is a common word (the anchor) with the chain of content words that follows it. The set of a text's signatures is its
fingerprint. Sets whose lengths differ too much can't be alike, so candidates are sought within partitions by set length, through the
signatures in a prefix of the set that suffices for the threshold, and compared by Jaccard likeness.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .linking import crowded, grouped, joined_keys
from .tokens import U64, Slice, distinct_in, hashes, bounds, mixed, slices

#: Anchors: frequent function words of some languages, in lower case.
ANCHORS = tuple(
    "the of and to in is that was for on with as be by at are this from or it an not "
    "der die das und ist nicht ein eine mit von zu den dem des auf für als auch sich im "
    "le la les de des et un une est que qui dans pour pas sur au avec ce il du "
    "el los las y en es no por con su para al lo como más se del una".split()
)
CHAIN = 2
BUCKET_ROWS = 2_000
#: Buckets are no more than that, however many rows there are, so that their edges fit the driver and a broadcast.
MOST_BUCKETS = 1 << 16
#: ASCII letters in lower case; other ASCII characters part words.
_FOLD = bytes(32 if c < 128 and not chr(c).isalpha() else (c + 32 if 65 <= c <= 90 else c) for c in range(256))


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode().translate(_FOLD), dtype=np.uint8)
    return int(hashes(raw, *bounds(raw))[0])


_ANCHOR_HASHES = np.array(sorted({_word_hash(w) for w in ANCHORS}), dtype=U64)


def _signatures(part: Slice, anchors: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, signature) of a slice, 32-bit signatures. Texts without an anchor's chain take every word as an anchor and every
    word as content; texts shorter than a chain are one signature."""
    n = len(part.hash)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    common = np.isin(part.hash, anchors)
    content = np.flatnonzero(~common)
    spot = np.flatnonzero(common)
    nth = np.searchsorted(content, spot)
    whole = nth + chain <= len(content)
    spot, nth = spot[whole], nth[whole]
    inside = part.doc[content[nth + chain - 1]] == part.doc[spot] if len(spot) else np.zeros(0, dtype=bool)
    spot, nth = spot[inside], nth[inside]
    value = part.hash[spot]
    for i in range(chain):
        value = value * U64(0x100000001B3) + part.hash[content[nth + i]]
    doc = part.doc[spot]
    bare = (np.bincount(doc, minlength=part.texts) == 0) & (part.count > 0)
    if bare.any():
        first, window = part.windows(chain + 1)
        chosen = bare[part.doc[first]]
        short = np.flatnonzero(bare & (part.count <= chain))
        one = np.zeros(len(short), dtype=U64)
        for i in range(chain):
            has = part.count[short] > i
            one[has] = one[has] * U64(0x100000001B3) + part.hash[part.first[short][has] + i]
        doc = np.concatenate([doc, part.doc[first[chosen]], short])
        value = np.concatenate([value, window[chosen], one])
    return distinct_in(doc, mixed(value) >> U64(32))


def signature_sets(texts: list[str], anchors: np.ndarray = _ANCHOR_HASHES, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted signatures of each text. Texts without a letter are taken by their words as they stand."""
    out: list[np.ndarray] = []
    for part in slices(texts):
        folded = [part.data[a:b] for a, b in zip(part.offset.tolist(), np.append(part.offset[1:] - 1, len(part.data)).tolist(), strict=True)]
        letters = Slice([x.translate(_FOLD) for x in folded], part.at)
        if (letters.count == 0).any():
            letters = Slice([x if not c else x.translate(_FOLD) for x, c in zip(folded, letters.count.tolist(), strict=True)], part.at)
        doc, value = _signatures(letters, anchors, chain)
        edges = np.searchsorted(doc, np.arange(part.texts + 1))
        out += [value[a:b].astype(np.uint32) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return out


def encoded(signatures: np.ndarray) -> str:
    """A fingerprint as text: its number of signatures, then the signatures."""
    return f"{len(signatures)}:{base64.b64encode(signatures.astype('<u4').tobytes()).decode()}" if len(signatures) else ""


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 1 if both are empty, 0 if their sizes already exclude `least`."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, own, doc_id, text) in order: each own row with the one below it."""
    held = None

    def emit(rows: list) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        sets = signature_sets(texts)
        out: dict[str, list] = {"doc_id": [], "n_chars": [], "edited_sha256": [], "fingerprint": [], "edited_fingerprint": [], "near_edited": [], "near_next": []}
        at = [i for i in range(len(rows) - 1) if rows[i][1]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in at]
        for i, text, changed in zip(at, edited, signature_sets(edited), strict=True):
            values = (rows[i][2], len(texts[i]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), encoded(sets[i]), encoded(changed), likeness(sets[i], changed), likeness(sets[i], sets[i + 1]))
            for column, x in zip(out.values(), values, strict=True):
                column.append(x)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not rows:
            continue
        if held and held[0] == rows[0][0]:
            rows.insert(0, held)
        held = rows[-1]
        yield emit(rows)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness, and that to the next document.

    The next document is the one with the next lower doc_id; after the lowest comes the highest. Documents are dealt to buckets of
    doc_id ranges; a bucket also gets the first document of the one below, so no neighbour is missed. Null texts count as empty, equal
    empty fingerprints are alike (1.0), an empty and another are not (0.0). Rows that repeat a doc_id stand in the order of their
    texts; a null doc_id stands below all. A table of one row is its own next. Other columns are ignored.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.coalesce("doc_id", F.lit(lowest)))
    total = docs.count()
    n = min(MOST_BUCKETS, max(1, total // bucket_rows))
    shares = [i / n for i in range(1, n)]
    edges = (rows.agg(F.percentile_approx("_id", shares, 10_000).alias("e")).first()["e"] or []) if shares else []
    bounds_desc = np.array(sorted(set(edges)), dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series((len(bounds_desc) - np.searchsorted(bounds_desc, ids.to_numpy(np.int64))).astype(np.int32))

    rows = rows.withColumn("bucket", bucket_of("_id"))
    heads = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("_id").alias("top")).collect())
    follow = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    tails = docs.sparkSession.createDataFrame(follow, "_id long, after int")
    dealt = rows.join(F.broadcast(tails), "_id", "left")
    spots = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own")), F.struct(F.col("after").alias("bucket"), F.lit(False).alias("own")))
    dealt = dealt.select("doc_id", "text", "_id", F.explode(F.filter(spots, lambda s: s["bucket"].isNotNull())).alias("s")).select("s.bucket", "s.own", "doc_id", "text", "_id")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc("_id"), "text")
    return ordered.select("bucket", "own", "doc_id", "text").mapInArrow(_compared, COMPARED)


def near_groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of documents linked by likeness of at least `threshold`; texts without signatures stand alone.

    Partitions by set length: partition p holds lengths from (1 / threshold) ** p on. A set seeks candidates in its own partition and the
    next, by the first signatures of its sorted set that it can't do without: alike sets share one of them.
    """

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch({"doc_id": batch.column(0), "sigs": pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))})

    base = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprint, "doc_id long, sigs array<long>").dropDuplicates(["doc_id"]))
    classes = base.filter("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("rep"))
    classes = written(classes)
    width = math.log(1 / threshold)
    prefix = F.slice("sigs", F.lit(1), (F.size("sigs") - F.ceil(F.size("sigs") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.size("sigs").cast("double")) / width + 1e-9).cast("int")
    keys = F.flatten(F.transform(prefix, lambda sig: F.transform(F.array(part, part + 1), lambda p: F.xxhash64(sig, p))))
    items = classes.select(F.col("rep").alias("item"), F.array_distinct(keys).alias("keys"))
    shared = written(crowded(items, F.col("keys")))

    def verify(pairs: DataFrame) -> DataFrame:
        a = classes.select(F.col("rep").alias("a"), F.col("sigs").alias("sa"))
        b = classes.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
        rows = pairs.join(a, "a").join(b, "b").filter(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")) - 1e-9)
        both = F.size(F.array_intersect("sa", "sb"))
        return rows.filter(both >= threshold * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")

    found = grouped(items, shared, [joined_keys(2)], verify)
    member = base.join(classes, "sigs", "left").select("doc_id", "rep")
    return member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep", "doc_id").alias("component_id"))
