"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of the corpus begin at word positions, and passages of `depth` words or more that occur in several documents are deep
internal nodes of their tree. The tree is built in memory-sized subtrees:

1. Each suffix is filed under a prefix, so that equal passages meet in one subtree. The prefix is that of the least suffix which
   begins inside the passage (longer words come first, so that frequent words seldom lead). Neighbouring suffixes then share a
   prefix, and travel together as one stretch of text.
2. Prefixes have variable lengths: one word, or, where more than `subtree` suffixes would share that word, the whole `depth` words.
3. A subtree's suffixes are ranked by prefix doubling (Karp, Miller and Rosenberg) on exact words. A class of equal ranks at `depth`
   is the deep internal node under which they hang; its smallest document keeps the passage, others lose the words it covers.
4. Suffixes under long prefixes need no tree: they are whole keys, aggregated with map-side combining and joined back, and AQE can
   split a hot key's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import U64, mixed, slices

DEPTH = 13
SUBTREE = 400_000
FOLDS = 1 << 16


def _leads(part, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage of `depth` words, and the key of the least suffix that begins in it."""
    n = len(part.hash)
    if n < depth:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    length = np.minimum(part.ends - part.starts, 255).astype(U64)
    key = ((U64(255) - length) << U64(56)) | (part.hash >> U64(8))
    least, span = key, 1
    while span * 2 <= depth:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < depth:
        least = np.minimum(least[: n - depth + 1], least[depth - span :][: n - depth + 1])
    whole = np.flatnonzero(part.doc[depth - 1 :] == part.doc[: n - depth + 1])
    return whole, mixed(least[whole])


def _counted(depth: int, folds: set[int] | None):
    """Passages by fold of their prefix, or, within given folds, by prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if folds is None else np.array(sorted(folds), dtype=U64)
        for batch in batches:
            found: dict[int, int] = {}
            for part in slices(batch.column(0).to_pylist()):
                _, lead = _leads(part, depth)
                if wanted is None:
                    lead = lead % U64(FOLDS)
                else:
                    lead = lead[np.isin(lead % U64(FOLDS), wanted)]
                for k, n in zip(*np.unique(lead.view(np.int64), return_counts=True), strict=True):
                    found[int(k)] = found.get(int(k), 0) + int(n)
            yield pa.record_batch({"prefix": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    return count


def frequent_prefixes(texts: DataFrame, depth: int, subtree: int) -> tuple[int, list[int]]:
    """The number of passages, and the one-word prefixes that more than `subtree` of them share.

    There are at most passages / subtree such prefixes; counting goes through 65,536 folds, so that single prefixes are counted only
    in folds which can hold one.
    """
    by_fold = texts.mapInArrow(_counted(depth, None), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect()
    heavy = {r["prefix"] for r in by_fold if r["n"] > subtree}
    if not heavy:
        return sum(r["n"] for r in by_fold), []
    hot = texts.mapInArrow(_counted(depth, heavy), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > subtree)
    return sum(r["n"] for r in by_fold), [r["prefix"] for r in hot.select("prefix").collect()]


def _stretches(depth: int, groups: int, hot: list[int]):
    """Packs, for each subtree, the stretches of text that hold its passages: compressed words, documents, places, passage counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(hot), dtype=np.int64).view(U64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bags: dict[int, list] = {}
            for part in slices(batch.column(1).to_pylist()):
                first, lead = _leads(part, depth)
                if len(frequent):
                    kept = ~np.isin(lead, frequent)
                    first, lead = first[kept], lead[kept]
                if not len(first):
                    continue
                group = (lead % U64(groups)).astype(np.int64)
                new = np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] != first[:-1] + 1)])
                at = np.flatnonzero(new)
                run = np.diff(np.append(at, len(first)))
                word, owner, group = first[at], part.doc[first[at]], group[at]
                left, right = part.starts[word], part.ends[word + run - 1 + depth - 1]
                place = word - part.first[owner]
                doc = ids[part.at + owner]
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                for rows in np.split(order, cuts):
                    bag = bags.setdefault(int(group[rows[0]]), [[], [], [], []])
                    bag[0].extend(part.data[a:b] for a, b in zip(left[rows].tolist(), right[rows].tolist(), strict=True))
                    bag[1].append(doc[rows])
                    bag[2].append(place[rows])
                    bag[3].append(run[rows])
            packer = zstandard.ZstdCompressor(level=3)
            columns: list[list] = [[], [], [], [], []]
            for g, (texts, *numbers) in sorted(bags.items()):
                columns[0].append(g)
                columns[1].append(packer.compress(b" ".join(texts)))
                for column, kind, arrays in zip(columns[2:], (np.int64, np.int32, np.int32), numbers, strict=True):
                    column.append(packer.compress(np.concatenate(arrays).astype(kind).tobytes()))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["subtree", "words", "docs", "places", "runs"])

    return pack


def _ranks(word: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for suffixes whose first `depth` words are equal, by prefix doubling. word: ranks of single words."""

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    rank, span = word.astype(np.int64), 1
    while span < depth:
        step = min(span, depth - span)
        if len(rank) <= step:
            return rank[:0]
        rank = paired(rank[:-step], rank[step:])
        span += step
    return rank


def _subtree(depth: int):
    """The deep internal nodes of one subtree: each document's passages that hang below a smaller document."""

    def build(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress

        def whole(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(unpack(x.as_py()), dtype=kind) for x in table.column(name)]).astype(np.int64)

        docs, places, runs = whole("docs", np.int64), whole("places", np.int32), whole("runs", np.int32)
        ids: dict[bytes, int] = {}
        word = np.concatenate([np.fromiter((ids.setdefault(w, len(ids)) for w in unpack(x.as_py()).split()), dtype=np.int32) for x in table.column("words")])
        del ids
        # Passage k of stretch s begins at word base[s] + k.
        base = np.concatenate([[0], np.cumsum(runs + depth - 1)[:-1]])
        stretch = np.repeat(np.arange(len(runs)), runs)
        within = np.arange(len(stretch)) - np.repeat(np.cumsum(runs) - runs, runs)
        node = _ranks(word, depth)[base[stretch] + within]
        doc = docs[stretch]
        smallest = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, node, doc)
        later = np.flatnonzero(smallest[node] < doc)
        doc, place = doc[later], (places[stretch] + within)[later]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        edges = np.concatenate([[0], cuts, [len(doc)]]) if len(doc) else np.zeros(1, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32()))
        return pa.table({"doc_id": pa.array(doc[edges[:-1]] if len(doc) else doc, pa.int64()), "places": lists})

    return build


def _long_prefixes(depth: int, hot: list[int]):
    """Passages under frequent prefixes, one row each, keyed by all their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(hot), dtype=np.int64).view(U64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1).to_pylist()):
                first, lead = _leads(part, depth)
                first = first[np.isin(lead, frequent)]
                owner = part.doc[first]
                keys = [hashlib.sha256(b" ".join(part.data[a:b].split())).digest() for a, b in zip(part.starts[first].tolist(), part.ends[first + depth - 1].tolist(), strict=True)]
                yield pa.record_batch({"passage": pa.array(keys, pa.binary()), "doc_id": pa.array(ids[part.at + owner], pa.int64()), "place": pa.array(first - part.first[owner], pa.int32())})

    return emit


def repeated_passages(docs: DataFrame, depth: int = DEPTH, subtree: int = SUBTREE) -> DataFrame:
    """Passages of `depth` words that also begin in a document with a smaller doc_id: (doc_id, places), where places are the sorted
    word positions at which they begin. A longer (maximal) repeat is a run of neighbouring places.

    Judged on the texts as they come. Null and empty texts, and texts below `depth` words, have none. Rows with a null doc_id take no
    part; rows that repeat a doc_id count as one document, with the places of all its rows. Other columns are ignored.
    """
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, hot = frequent_prefixes(rows.select("text"), depth, subtree)
    groups = max(1, -(-total * 2 // subtree))
    packed = rows.mapInArrow(_stretches(depth, groups, hot), "subtree long, words binary, docs binary, places binary, runs binary")
    found = packed.groupBy("subtree").applyInArrow(_subtree(depth), "doc_id long, places array<int>")
    if hot:
        passages = written(rows.mapInArrow(_long_prefixes(depth, hot), "passage binary, doc_id long, place int"))
        smallest = passages.groupBy("passage").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_last")).filter("_least < _last")
        below = passages.join(smallest, "passage").filter("doc_id > _least")
        found = found.unionByName(below.groupBy("doc_id").agg(F.collect_list("place").alias("places")))
    return found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))


def _cut(depth: int):
    """Removes the words that passages cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for doc_id, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if places:
                    gone = np.zeros(n + 1, dtype=np.int32)
                    at = np.minimum(places, n)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + depth, n), -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                out["doc_id"].append(doc_id)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return cut


def deduplicate_substrings(docs: DataFrame, depth: int = DEPTH, subtree: int = SUBTREE) -> DataFrame:
    """Each row of docs without the words of passages that a smaller document has too.

    Returns doc_id, n_words, n_removed (long) and kept (the kept words, joined by one space). One row out for each row in; null text
    counts as empty; rows with a null doc_id lose nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both sides are shuffled at every size, so that what a small run needs tells what a large one does.
    places = repeated_passages(docs, depth, subtree).hint("shuffle_merge")
    joined = rows.join(places, "doc_id", "left")
    return joined.select("doc_id", "text", "places").mapInArrow(_cut(depth), "doc_id long, n_words long, n_removed long, kept string")
