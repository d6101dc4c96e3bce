"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than the six ASCII white-space characters. Texts are handled in slices of a quarter MB, so that memory is
bounded by a slice or by one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 << 10
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(_R))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        a = np.full(max(n, SLICE_BYTES + 2), base, dtype=U64)
        a[0] = 1
        _powers[base] = np.multiply.accumulate(a)
    return _powers[base][:n]


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial: a function of the word's bytes alone."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    n = len(raw)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[raw] * powers(_R, n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_R_INV, n)[starts]
    return mixed(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Slice:
    """The words of some consecutive texts. doc: the index of each word's text; first, count: each text's words."""

    def __init__(self, texts: list[bytes], at: int):
        self.at, self.texts = at, len(texts)
        self.data = b" ".join(texts)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.starts, self.ends = bounds(raw)
        self.hash = hashes(raw, self.starts, self.ends)
        edges = np.searchsorted(self.starts, np.append(self.offset, len(raw) + 1))
        self.first, self.count = edges[:-1], np.diff(edges)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and a 64-bit hash, of every run of k words within one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        whole = np.flatnonzero(self.doc[k - 1 :] == self.doc[: n - k + 1])
        value = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            value = value * U64(0x100000001B3) + self.hash[i : n - k + 1 + i]
        return whole, mixed(value[whole])


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def slices(texts: list[str | None], fold: bytes | None = None) -> Iterator[Slice]:
    """Cuts a batch of texts (null: empty) into slices; each text is whole in one slice. fold: a table that maps single bytes."""
    part: list[bytes] = []
    size = at = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(data) > SLICE_BYTES:
            yield Slice(part, at)
            part, size, at = [], 0, i
        part.append(data.translate(fold) if fold else data)
        size += len(data) + 1
    if part:
        yield Slice(part, at)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take SLICE_BYTES at most, or are one text: what is made of a batch takes memory for no more. Nothing is copied."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def distinct_in(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) pairs, sorted."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    if not len(g):
        return g, v
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return g[new], v[new]
