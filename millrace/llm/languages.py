"""Language ID of mixed-language text.

Words are runs of letters. The script range of a word's first letter narrows the languages that come into question; each of those gets
a score from the word's character n-grams. A Viterbi path over a text's words, with a penalty for each switch of language, labels spans;
the language with the most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import U64, mixed

#: First and last code point of script ranges; letters outside are of script 0.
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF),
    ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(["other", *(name for name, _, _ in SCRIPTS)]))
ORDERS = (2, 3, 4)
BINS = 1 << 16
#: Labelled documents per language, about, from which the model learns; all of them where there are fewer.
SAMPLE = 5_000
SWITCH = 12.0
SLICE_CHARS = 1 << 20


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower case, its script."""
    chars = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), dtype=bool, count=len(chars))
    lower = np.fromiter((ord(c.lower()[0]) for c in chars), dtype=np.uint32, count=len(chars))
    script = np.zeros(len(chars), dtype=np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


class Words:
    """The words of some texts: code points (lower case, blanks between words), first and last place, text and script of each word."""

    def __init__(self, texts: list[str]):
        letter, lower, script = _alphabet()
        raw = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.cumsum(sizes + 1) - sizes  # of each text
        inside = letter[raw]
        self.points = np.where(inside, lower[raw], 32).astype(U64)
        step = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.doc = np.searchsorted(self.offset, self.starts, side="right") - 1
        self.script = script[raw[self.starts]]
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def grams(self, n: int) -> np.ndarray:
        """The bin of the n-gram that begins at each code point."""
        m = len(self.points) - n + 1
        value = np.full(max(m, 0), n, dtype=U64)
        for i in range(n):
            value = value * U64(0x100000001B3) + self.points[i : m + i]
        return (mixed(value) & U64(BINS - 1)).astype(np.int64)

    def spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each word, with a blank before and after it, as first and end place."""
        first = self.starts - 1
        return first, np.maximum(first, self.ends - n + 2)


def _texts(values: list) -> Iterator[tuple[int, list[str]]]:
    at = size = 0
    part: list[str] = []
    for i, text in enumerate(values):
        if part and size + len(text or "") > SLICE_CHARS:
            yield at, part
            part, size, at = [], 0, i
        part.append(text or "")
        size += len(part[-1])
    if part:
        yield at, part


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 marks what is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


@dataclass
class Model:
    """languages: in order; scores: (order, language, bin) log likelihoods; scripts: (language, script) seen in training."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-gram bins (slot order * BINS + bin) and of scripts' letters (slots from 3 * BINS on), by language."""
    width = len(ORDERS) * BINS
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, texts in _texts(batch.column(1).to_pylist()):
            words = Words(texts)
            own = np.array([langs[at + i] for i in range(len(texts))], dtype=object)
            for lang in set(own):
                total = totals.setdefault(lang, np.zeros(width + len(SCRIPT_NAMES), dtype=np.int64))
                mine = (own == lang)[words.doc]
                total[width:] += np.bincount(words.script[mine], weights=(words.ends - words.starts)[mine], minlength=len(SCRIPT_NAMES)).astype(np.int64)
                for k, n in enumerate(ORDERS):
                    gram, (first, end) = words.grams(n), words.spans(n)
                    step = np.zeros(len(words.points) + 1, dtype=np.int32)
                    np.add.at(step, first[mine], 1)
                    np.add.at(step, end[mine], -1)
                    used = np.cumsum(step)[: len(gram)] > 0
                    total[k * BINS : (k + 1) * BINS] += np.bincount(gram[used], minlength=BINS)
    for lang, total in totals.items():
        slot = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array([lang] * len(slot), pa.string()), "slot": pa.array(slot, pa.int64()), "n": pa.array(total[slot], pa.int64())})


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows of doc_id, text and lang; null texts and langs teach nothing.

    It learns from about `sample` rows of each language, chosen by a hash of doc_id, or from all where there are fewer. What the
    driver gets is bounded by the languages, n-gram orders and bins. An empty table gives a model without languages.
    """
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    width = len(ORDERS) * BINS
    counts = np.zeros((len(languages), width + len(SCRIPT_NAMES)))
    if languages:
        chance = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
        drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(chance, F.col("lang")) * (1 << 20))
        for r in drawn.select("lang", "text").mapInArrow(_counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[languages.index(r["lang"]), r["slot"]] = r["n"]
    grams = counts[:, :width].reshape(len(languages), len(ORDERS), BINS).transpose(1, 0, 2) + 0.5
    scores = np.log(grams / grams.sum(axis=2, keepdims=True))
    letters = counts[:, width:]
    return Model(languages, (scores - scores.mean(axis=1, keepdims=True)).astype(np.float32) if languages else scores.astype(np.float32), letters > 0.01 * letters.sum(axis=1, keepdims=True))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(word, language) log likelihoods, less their mean, a third for each n-gram order; languages without the word's script get a low score."""
    out = np.zeros((len(words.starts), len(model.languages)))
    for k, n in enumerate(ORDERS):
        gram, (first, end) = words.grams(n), words.spans(n)
        for j in range(len(model.languages)):
            sums = np.concatenate([[0.0], np.cumsum(model.scores[k, j][gram], dtype=np.float64), np.zeros(1)])
            out[:, j] += (sums[np.minimum(end, len(gram))] - sums[np.minimum(first, len(gram))]) / len(ORDERS)
    fits = model.scripts[:, words.script].T
    narrowed = fits.any(axis=1)[:, None] & ~fits
    out[narrowed] = np.minimum(out, 0)[narrowed] - SWITCH
    return out


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row of scores: the sum of the labels' scores less `switch` for each change is greatest."""
    n, k = scores.shape
    back = np.empty((n, k), dtype=np.int64)
    best, own = scores[0].copy(), np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        change = best[top] - switch > best
        back[t] = np.where(change, top, own)
        best = np.where(change, best[top] - switch, best) + scores[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def labels(words: Words, scores: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Each word's language by Viterbi, and (text, language) sums of scores.

    A text in which no span of another language gains half a switch over the best single language has that language as its best path
    (k spans gain k / 2 switches at most and cost k - 1), so only the other texts go through the steps.
    """
    texts, k = len(words.count), scores.shape[1]
    total = np.stack([np.bincount(words.doc, weights=scores[:, j], minlength=texts) for j in range(k)], axis=1)
    single = total.argmax(axis=1)
    path = single[words.doc]
    if not len(path):
        return path, total
    mixed_text = np.zeros(texts, dtype=bool)
    ahead = scores - scores[np.arange(len(path)), path][:, None]
    new = np.zeros(len(path), dtype=bool)
    new[words.first[words.count > 0]] = True
    for j in range(k):
        sums = np.cumsum(ahead[:, j])
        apart = (float(np.ptp(sums)) + abs(float(ahead[:, j].max())) + 1.0) * words.doc
        before = np.where(new, 0.0, 0.0) + (sums - ahead[:, j])
        gain = sums - (np.minimum.accumulate(before - apart) + apart)
        mixed_text[words.doc[gain > switch / 2]] = True
    for d in np.flatnonzero(mixed_text):
        rows = slice(words.first[d], words.first[d] + words.count[d])
        path[rows] = viterbi(scores[rows], switch)
    return path, total


IDENTIFIED = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def _identify(model, switch: float):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.languages)
        for batch in batches:
            values = batch.column(1).to_pylist()
            for at, texts in _texts(values):
                words = Words(texts)
                out: list[tuple] = [("und", 0.0, [])] * len(texts)
                if k and len(words.starts):
                    scores = word_scores(words, m)
                    path, total = labels(words, scores, switch)
                    letters = np.bincount(words.doc * k + path, weights=words.ends - words.starts, minlength=len(texts) * k).reshape(len(texts), k)
                    chosen = letters.argmax(axis=1)
                    share = letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
                    odds = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
                    change = np.concatenate([[True], (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])])
                    head = np.flatnonzero(change)
                    last = np.append(head[1:], len(path)) - 1
                    owner = words.doc[head]
                    lo, hi = words.starts[head] - words.offset[owner], words.ends[last] - words.offset[owner]
                    spans: list[list] = [[] for _ in texts]
                    for d, a, b, x in zip(owner.tolist(), lo.tolist(), hi.tolist(), path[head].tolist(), strict=True):
                        spans[d].append({"start": a, "end": b, "lang": m.languages[x]})
                    score = np.where(share < 1, share, odds)
                    out = [(m.languages[c], s, x) if n else ("und", 0.0, []) for c, s, x, n in zip(chosen.tolist(), score.tolist(), spans, words.count.tolist(), strict=True)]
                columns = list(zip(*out, strict=True))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], span)], names=["doc_id", "lang_pred", "score", "spans"])

    return identify


def identify_languages(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and spans (start and end code point, lang) of each row of docs.

    A text that is null, or has no letter, is `und`, with score 0 and no span; so are all under a model without languages. A
    one-language text's score is the share of that language in the likelihoods; a mixed text's is the share of its letters. Rows that
    repeat are judged alike, each on its own. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(shared, switch), IDENTIFIED)
