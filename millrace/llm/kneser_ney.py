"""Perplexity under an interpolated n-gram model with modified Kneser-Ney smoothing.

Words and n-grams are counted in Spark: tasks send each shard the sorted, counted n-grams of a few MB of text at a time, and a shard merges
what it gets. A shard is a range of hashes, so no frequent word or context makes it large. Each shard is stored as arrays sorted by hash, in the
shared folder; scoring tasks map them into memory and search them, so that a worker holds the pages that it touches and no more.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder
from .tokens import LOWER, U64, mixed, slices

#: The end of a text, as the hash of a word; what stands before a text, and an unknown word, as ids.
END = mixed(np.array([0xE0D], dtype=U64))[0]
BEGIN, UNKNOWN = np.int64(1 << 62), np.int64(-1)
#: A word's id is its shard, shifted by so much, and its place there.
PLACE_BITS = 40
FLUSH_TOKENS = 3_000_000
#: Tokens that are looked up together. Each look-up goes through all shards, which are more with more text: with few tokens at a time that would outweigh the rest.
STEP_TOKENS = 1_000_000
SHARD_BYTES = 24 << 20
#: Discounts where counts of counts are too few to estimate them.
FALLBACK = (0.5, 1.0, 1.5)
#: Arrays that a worker keeps mapped: ten a shard are searched in turn, so that fewer places than arrays would keep none. A process may have 65,530 mappings.
MAPPED = 1 << 14 if sys.version_info >= (3, 13) else 1 << 10
PIECES = "shard long, data binary"


def remainder(doc_id: Column, n: int = 10) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


def pack(columns: list[np.ndarray]) -> bytes:
    """64-bit columns of one length, the first of them rising: as differences, byte by byte, compressed."""
    first = columns[0].astype(np.int64, copy=True)
    first[1:] -= columns[0][:-1].astype(np.int64)
    planes = [c.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T for c in [first, *columns[1:]]]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), dtype=np.uint8).reshape(-1, 8, n)
    columns = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
    return [np.cumsum(columns[0]), *columns[1:]]


def counted(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sums of n."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row."""
    value = np.full(len(columns[0]), 0x51ED270B, dtype=U64)
    for c in columns:
        value = mixed(value * U64(0x100000001B3) + c.view(U64))
    return value


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how many bits name a shard, and the sums over all shards. facts: for each order from 1, n1 to n4, the counts of
    counts; whole: total, N1, N2, N3+ of the empty context."""

    folder: str
    bits: int
    order: int
    tokens: int = 0
    words: int = 0
    facts: tuple[tuple[int, ...], ...] = ()
    whole: tuple[int, ...] = (0, 0, 0, 0)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64)

    def path(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}/{int(shard):08d}.npy"

    def discounts(self, k: int) -> np.ndarray:
        """What is taken off counts of 0, 1, 2, and 3 or more in order k."""
        n = self.facts[k - 1]
        if not all(n):
            return np.array([0.0, *FALLBACK])
        y = n[0] / (n[0] + 2 * n[1])
        return np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3))])


def put(path: str, write) -> None:
    """Writes a file whole or not at all; a task that runs again writes the same."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        write(out)
    os.replace(part, path)


def save(path: str, values: np.ndarray) -> None:
    put(path, lambda out: np.save(out, values.astype(np.min_scalar_type(values.max())) if len(values) and values.dtype != U64 else values))


@lru_cache(maxsize=MAPPED)
def mapped(path: str) -> np.ndarray | None:
    """An array of the shared folder, mapped into memory; None: the shard has none. No file stays open."""
    try:
        with open(path, "rb") as file:
            np.lib.format.read_magic(file)
            shape, _, dtype = np.lib.format.read_array_header_1_0(file)
            if not shape[0]:
                return np.zeros(0, dtype=dtype)
            # Before Python 3.13 a mapping keeps its file open.
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
            return np.frombuffer(data, dtype=dtype, offset=file.tell())
    except FileNotFoundError:
        return None


def places(model: Model, kind: str, shards: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard that has some of the hashes: its number, the indices of those found, and their places in its arrays."""
    order = np.lexsort((hashes, shards))
    edges = np.flatnonzero(np.diff(shards[order], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        own, shard = order[lo:hi], int(shards[order[lo]])
        array = mapped(model.path(kind, shard))
        if array is not None and len(array):
            at = np.minimum(np.searchsorted(array, hashes[own]), len(array) - 1)
            there = array[at] == hashes[own]
            yield shard, own[there], at[there]


def word_ids(model: Model, hashes: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by their hashes (UNKNOWN: not in training), and their counts if asked for."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, n = np.full(len(distinct), UNKNOWN), np.zeros(len(distinct), dtype=np.int64)
    for shard, own, at in places(model, "words", model.shard(distinct), distinct):
        ids[own] = (shard << PLACE_BITS) + at
        if counts:
            n[own] = mapped(model.path("word_counts", shard))[at]
    return ids[back], n[back]


def streams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of texts of STEP_TOKENS: its place, its number of texts, the hashes of their words and ends in order, and the text of each."""
    held, docs, at, n, size = [], [], 0, 0, 0
    for part in slices(texts, LOWER):
        hashes = np.full(len(part.hash) + part.texts, END)
        hashes[np.arange(len(part.hash)) + part.doc] = part.hash
        held.append(hashes)
        docs.append(np.repeat(np.arange(n, n + part.texts), part.count + 1))
        n += part.texts
        size += len(hashes)
        if size >= min(STEP_TOKENS, FLUSH_TOKENS):
            yield at, n, np.concatenate(held), np.concatenate(docs)
            held, docs, at, n, size = [], [], at + n, 0, 0
    if n:
        yield at, n, np.concatenate(held), np.concatenate(docs)


def grams(ids: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, as columns; BEGIN stands before each text."""
    columns = [ids]
    for back in range(1, order):
        c = np.full(len(ids), BEGIN)
        c[back:] = np.where(doc[back:] == doc[:-back], ids[:-back], BEGIN)
        columns.append(c)
    return columns[::-1]


def dealt(columns: list[np.ndarray], n: np.ndarray, shards: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The rows, which are in order, as one packed piece for each shard."""
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.diff(shards[order], prepend=-1))
    names, data = [], []
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[lo:hi]
        names.append(int(shards[own[0]]))
        data.append(pack([*(c[own] for c in columns), n[own]]))
    return names, data


def context_shards(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """A word goes where its own arrays are, an n-gram to the shard of its context."""
    return columns[0] >> PLACE_BITS if len(columns) == 1 else model.shard(fold(columns[:-1]))


def _count(model: Model, order: int):
    """Counts the words (order 0: by hash) or n-grams (by ids) of texts, FLUSH_TOKENS at a time."""

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns, n = counted([np.concatenate(c) for c in zip(*held, strict=True)], np.ones(sum(len(h[0]) for h in held), dtype=np.int64))
        names, data = dealt(columns, n, context_shards(model, columns) if order else model.shard(columns[0]))
        return pa.record_batch({"shard": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, hashes, doc in streams(batch.column(0).to_pylist()):
                held.append(grams(word_ids(model, hashes)[0], doc, order) if order else [hashes])
                size += len(hashes)
                if size >= FLUSH_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return count


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    pieces = [unpack(x) for x in table.column("data").to_pylist()]
    *columns, n = [np.concatenate(c) for c in zip(*pieces, strict=True)]
    return counted(columns, n)


def _store_words(model: Model):
    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        pieces = [unpack(x) for x in table.column("data").to_pylist()]
        (hashes,), n = counted([np.concatenate([p[0] for p in pieces]).view(U64)], np.concatenate([p[1] for p in pieces]))
        save(model.path("words", shard), hashes)
        save(model.path("word_counts", shard), n)
        return pa.table({"words": pa.array([len(hashes)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return store


def tallies(n: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sums of n, and how often it is 1, 2, and 3 or more, in runs that begin at `at`."""
    return [np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)]


def _store_grams(model: Model, k: int):
    """Stores the n-grams of order k of one shard, and deals out how many different ones each shorter n-gram ends."""

    def store(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        columns, n = _merged(table)
        facts = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        if k == 1:
            counts = np.zeros(len(mapped(model.path("words", shard))), dtype=np.int64)
            counts[columns[0] - (shard << PLACE_BITS)] = n
            save(model.path("grams1_counts", shard), counts)
            whole = [int(x[0]) for x in tallies(n, np.zeros(1, dtype=np.int64))]
            names, data = [], []
        else:
            whole = [0, 0, 0, 0]
            value = fold(columns)
            order = np.argsort(value)
            save(model.path(f"grams{k}", shard), value[order])
            save(model.path(f"grams{k}_counts", shard), n[order])
            begins = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)]))
            contexts = fold([c[begins] for c in columns[:-1]])
            order = np.argsort(contexts)
            save(model.path(f"contexts{k}", shard), contexts[order])
            for name, x in zip(("total", "once", "twice", "more"), tallies(n, begins), strict=True):
                save(model.path(f"contexts{k}_{name}", shard), x[order])
            # An n-gram at the beginning of a text has nothing before it: it keeps its count.
            shorter, n = counted(columns[1:], np.where(columns[1] == BEGIN, n, 1))
            names, data = dealt(shorter, n, context_shards(model, shorter))
        put(f"{model.folder}/facts/{k}-{shard}.json", lambda out: out.write(json.dumps({"k": k, **{f"n{i + 1}": x for i, x in enumerate(facts)}, **{f"t{i}": x for i, x in enumerate(whole)}}).encode()))
        return pa.table({"shard": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})

    return store


def local_folder(uri: str) -> str:
    """The path of a file: URI; arrays can be mapped only where all executors mount the shared folder."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model needs a folder that executors mount as a path, not {uri}: name one in `folder`")
    return unquote(parts.path)


def train(docs: DataFrame, order: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts the texts of docs (null: empty) and stores the model in a new folder of `folder` (None: the shared folder).

    A text's tokens are its words, A-Z in lower case, and one end. Every word and n-gram counts; nothing is pruned, so the model grows with docs.
    Shards are as many as bytes of text / shard_bytes need; the driver gets sums alone.
    """
    spark = docs.sparkSession
    if order < 2:
        raise ValueError("order must be 2 or more")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    bits = max(0, (max(1, -(-size // shard_bytes)) - 1).bit_length())
    model = Model(f"{local_folder(folder or shared_folder(spark))}/kneser_ney/{uuid.uuid4().hex}", bits, order)
    words = texts.mapInArrow(_count(model, 0), PIECES).groupBy("shard").applyInArrow(_store_words(model), "words long, tokens long")
    n_words, n_tokens = words.agg(F.sum("words"), F.sum("tokens")).first()
    pieces = texts.mapInArrow(_count(model, order), PIECES)
    for k in range(order, 0, -1):
        pieces = pieces.groupBy("shard").applyInArrow(_store_grams(model, k), PIECES)
    pieces.count()  # one job stores all orders
    fields = [*(f"n{i}" for i in range(1, 5)), *(f"t{i}" for i in range(4))]
    rows = {}
    if n_words:
        stored = spark.read.schema(", ".join(f"{c} long" for c in ["k", *fields])).json(f"file://{model.folder}/facts")
        rows = {r.k: r for r in stored.groupBy("k").agg(*(F.sum(c).alias(c) for c in fields)).collect()}
    facts = tuple(tuple(rows[k][c] for c in fields[:4]) if k in rows else (0, 0, 0, 0) for k in range(1, order + 1))
    whole = tuple(rows[1][c] for c in fields[4:]) if 1 in rows else (0, 0, 0, 0)
    return Model(model.folder, bits, order, n_tokens or 0, n_words or 0, facts, whole)


def _discounted(model: Model, k: int, n: np.ndarray) -> np.ndarray:
    return n - model.discounts(k)[np.minimum(n, 3)]


def probabilities(model: Model, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each token after those before it in its text."""
    total, *few = model.whole
    share = np.dot(model.discounts(1)[1:], few) / total if total else 1.0
    counts = np.zeros(len(ids), dtype=np.int64)
    known = np.flatnonzero(ids >= 0)
    shards = ids[known] >> PLACE_BITS
    for shard in np.unique(shards).tolist():
        own = known[shards == shard]
        counts[own] = mapped(model.path("grams1_counts", shard))[ids[own] - (shard << PLACE_BITS)]
    p = (_discounted(model, 1, counts) / total if total else 0.0) + share / (model.words + 1)
    columns = grams(ids, doc, model.order)
    for k in range(2, model.order + 1):
        own = columns[-k:]
        context = fold(own[:-1])
        distinct, first, back = np.unique(context, return_index=True, return_inverse=True)
        shards, seen, stats = model.shard(distinct), np.zeros(len(distinct), dtype=bool), np.zeros((4, len(distinct)), dtype=np.int64)
        for shard, there, at in places(model, f"contexts{k}", shards, distinct):
            seen[there] = True
            for i, name in enumerate(("total", "once", "twice", "more")):
                stats[i, there] = mapped(model.path(f"contexts{k}_{name}", shard))[at]
        rest = np.where(seen, np.dot(model.discounts(k)[1:], stats[1:]) / np.maximum(stats[0], 1), 1.0)
        value, back_gram = np.unique(fold(own), return_inverse=True)
        of_gram = np.zeros(len(value), dtype=np.int64)
        of_gram[back_gram] = back
        n = np.zeros(len(value), dtype=np.int64)
        for shard, there, at in places(model, f"grams{k}", shards[of_gram], value):
            n[there] = mapped(model.path(f"grams{k}_counts", shard))[at]
        n = n[back_gram]
        p = _discounted(model, k, n) / np.maximum(stats[0], 1)[back] + rest[back] * p
    return p


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, n_known = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            base, own = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, texts, hashes, doc in streams(batch.column(1).to_pylist()):
                ids, counts = word_ids(model, hashes, counts=True)
                sums = lambda x, doc=doc, texts=texts: np.bincount(doc, weights=x, minlength=texts)
                here = slice(at, at + texts)
                n_tokens[here] = np.bincount(doc, minlength=texts)
                n_known[here] = np.bincount(doc[counts > 0], minlength=texts)
                base[here] = sums(np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1))))
                own[here] = sums(np.log10(probabilities(model, ids, doc)))
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": own, "perplexity": 10 ** (-own / n_tokens)})

    return score


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known (tokens seen in training), base_score, score (log10 probabilities of the text), perplexity (a token) of each row.

    A null text counts as empty: it has its end alone. Equal rows have equal scores; other columns of docs are left out. An empty model
    gives every token the same probability. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
