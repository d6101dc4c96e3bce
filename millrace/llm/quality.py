"""Quality rules: compression bands.

Repetitive text compresses far better than prose, and encoded or random text hardly at all. The zstandard ratio (bytes per compressed
byte) of the whole text, and of fixed chunks of it, must lie in a band; the band depends on the length, as short texts compress less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .tokens import pieces, slices

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """bands: (bytes from which it holds, least ratio, greatest ratio), by rising length. Chunks of `chunk` bytes (a last one of half
    that size at least) must lie in chunk_band, but for a share of `odd_chunks`."""

    bands: tuple[tuple[int, float, float], ...] = ((0, 0.0, 4.0), (256, 1.1, 4.5), (1024, 1.25, 5.0), (4096, 1.35, 6.0), (16384, 1.35, 8.0))
    chunk: int = 4096
    chunk_band: tuple[float, float] = (1.3, 6.0)
    odd_chunks: float = 0.25
    level: int = 3
    least_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30


def repeated_words(part, k: int) -> np.ndarray:
    """For each text of a slice, the words in runs of k words that the text has twice or more."""
    first, window = part.windows(k)
    doc = part.doc[first]
    order = np.lexsort((window, doc))
    same = (window[order][1:] == window[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(first), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(part.hash) + 1, dtype=np.int32)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + k, -1)
    return np.bincount(part.doc[np.cumsum(step[:-1]) > 0], minlength=part.texts)


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def in_bands(data: bytes, rules: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """The ratio of the whole text, the share of its chunks outside their band, and the verdict."""
    n = len(data)
    ratio = n / max(1, len(packer.compress(data)))
    least, most = next((lo, hi) for at, lo, hi in reversed(rules.bands) if n >= at)
    pieces = [data[i : i + rules.chunk] for i in range(0, n, rules.chunk) if min(n - i, rules.chunk) * 2 >= rules.chunk]
    ratios = [len(x) / len(packer.compress(x)) for x in pieces] if n > rules.chunk else []
    odd = sum(not rules.chunk_band[0] <= x <= rules.chunk_band[1] for x in ratios) / max(1, len(ratios))
    return ratio, odd, least <= ratio <= most and odd <= rules.odd_chunks


def _judge(rules: Bands):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for batch in pieces(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n_words, n_repeat = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for part in slices(texts):
                n_words[part.at : part.at + part.texts] = part.count
                n_repeat[part.at : part.at + part.texts] = repeated_words(part, rules.repeat_window)
            datas = [x.encode("utf-8", "surrogatepass") for x in texts]
            white = [sum(x.count(c) for c in " \t\n\x0b\x0c\r") for x in texts]
            verdicts = [in_bands(x, rules, packer) for x in datas]
            failed = (n_words < rules.least_words) | (100 * n_repeat > rules.repeat_percent * n_words)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_words": pa.array(n_words),
                    "word_chars": pa.array([len(x) - w for x, w in zip(texts, white, strict=True)], pa.int64()),
                    "n_symbols": pa.array([len(x) - len(x.translate(None, SYMBOLS)) for x in datas], pa.int64()),
                    "n_dup_lines": pa.array([duplicate_lines(x) for x in texts], pa.int64()),
                    "n_repeat_words": pa.array(n_repeat),
                    "base_failed": pa.array(failed),
                    "ratio": pa.array([x[0] for x in verdicts], pa.float64()),
                    "odd_chunks": pa.array([x[1] for x in verdicts], pa.float64()),
                    "kept": pa.array([v[2] and not f for v, f in zip(verdicts, failed.tolist(), strict=True)]),
                    **{name: batch.column(i) for i, name in enumerate(batch.schema.names) if i > 1},
                }
            )

    return judge


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, odd_chunks double, kept boolean"


def judge_quality(docs: DataFrame, rules: Bands = Bands()) -> DataFrame:
    """Counts, compression figures and verdict of each row.

    A null text counts as empty, and fails for want of words. Rows that repeat are judged alike, each on its own; other columns of
    docs are left out. The order of rows doesn't matter. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge(rules), VERDICT)


def keep_quality(docs: DataFrame, rules: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass, with their columns as they were, of any name."""
    judge = _judge(rules)
    names, helpers = docs.columns, [fresh(docs, "row_id"), fresh(docs, "row_text")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(names) + 1):
            verdict = next(judge(iter([batch.select(helpers).rename_columns(["doc_id", "text"])])))
            yield batch.select(names).filter(verdict.column("kept"))

    return docs.select("*", F.col("doc_id").cast("long").alias(helpers[0]), F.col("text").alias(helpers[1])).mapInArrow(keep, docs.schema)
