"""The n-gram model against one of plain dictionaries, with many shards and flushes, and its sums to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import kneser_ney as K
from millrace.llm import registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, n_tokens string"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), "\n"]


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Plain:
    """Chen and Goodman's formulas, word by word."""

    def __init__(self, texts, order):
        self.order, self.unigrams = order, Counter()
        counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = tokens(text)
            self.unigrams.update(t)
            padded = ["<s>"] * (order - 1) + t
            for i in range(len(t)):
                counts[order][tuple(padded[i : i + order])] += 1
        for k in range(order - 1, 0, -1):
            for gram, n in counts[k + 1].items():
                counts[k][gram[1:]] += n if gram[1] == "<s>" else 1
        self.counts, self.discounts, self.contexts = counts, [None], [None]
        for k in range(1, order + 1):
            n = [sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3)] if all(n) else [0.5, 1.0, 1.5]
            self.discounts.append(d)
            context = defaultdict(lambda: [0, 0, 0, 0])
            for gram, v in counts[k].items():
                context[gram[:-1]][0] += v
                context[gram[:-1]][min(v, 3)] += 1
            self.contexts.append(context)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.unigrams) + 1)
        lower = self.p(gram[1:])
        if gram[:-1] not in self.contexts[k]:
            return lower
        total, *few = self.contexts[k][gram[:-1]]
        c = self.counts[k][gram]
        d = self.discounts[k]
        return (c - d[min(c, 3) - 1] if c else 0) / total + sum(x * y for x, y in zip(d, few, strict=True)) / total * lower

    def score(self, text):
        t = tokens(text)
        padded = ["<s>"] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(t)))

    def base(self, text):
        n, v = self.unigrams.total(), len(self.unigrams)
        return sum(math.log10((self.unigrams[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text))


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    odd = [(None, "no id"), (-1, None), (-2, ""), (-3, " \n"), (-4, "THE The the ÄÖ äö\x0bb　c \U0001f600"), (-5, "x " * 5000), (-5, "x " * 5000), (-6, "unseen" + "y" * 20_000), (-7, "\x00 a")]
    return [tuple(r) for r in docs] + odd


@pytest.mark.parametrize("order, shard_bytes, flush", [(2, 30_000, 5000), (3, 100_000, 20_000), (2, 1 << 30, 3_000_000)])
def test_scores(spark, rows, order, shard_bytes, flush, monkeypatch):
    df = spark.createDataFrame([(*r, "s", "n") for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(K, "FLUSH_TOKENS", flush)
    training = [t for i, t in rows if not held_out(i)]
    model = K.train(df.filter(K.remainder(df.doc_id) != 0), order, shard_bytes=shard_bytes)
    plain = Plain(training, order)
    assert model.bits > 0 or shard_bytes == 1 << 30
    assert (model.tokens, model.words) == (plain.unigrams.total(), len(plain.unigrams))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in K.score_texts(df, model).collect()), key=repr)
    want = sorted(((i, len(tokens(t)), sum(w in plain.unigrams for w in tokens(t)), plain.base(t), plain.score(t)) for i, t in rows), key=repr)
    assert sorted(g[:3] for g in got if g[0] is not None) == sorted(w[:3] for w in want if w[0] is not None)
    for g, w in zip(sorted(got, key=lambda x: (x[:3], x[4]).__repr__()), sorted(want, key=lambda x: (x[:3], x[4]).__repr__()), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b d", "a b c", "c c a", "d", "b a d c a b", "e f g h a a"]
    model = K.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 3, shard_bytes=8)
    assert model.bits > 1
    words = [*"abcdefgh", "\n", "never"]
    for before in (["a", "b"], ["d"], [], ["never", "a"], ["h", "g"]):
        total = 0.0
        for w in words:
            _, _, hashes, doc = next(K.streams([" ".join([*before, w])]))
            if w == "\n":
                hashes, doc = hashes[-len(before) - 1 :], doc[-len(before) - 1 :]
            ids, _ = K.word_ids(model, hashes)
            total += K.probabilities(model, ids, doc)[len(before)]
        assert total == pytest.approx(1.0)


def test_pieces_come_back():
    columns = [np.array([-5, 0, 0, 7, 1 << 62]), np.array([1 << 62, -1, 3, 3, 0]), np.array([1, 2, 3, 4, 5])]
    assert all((a == b).all() for a, b in zip(columns, K.unpack(K.pack(columns)), strict=True))
    hashes = np.sort(K.mixed(np.arange(1000, dtype=np.uint64)))
    assert (K.unpack(K.pack([hashes]))[0].view(np.uint64) == hashes).all()


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = K.train(none)
    assert K.score_texts(none, model).count() == 0
    row = K.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.score, row.base_score) == (3, 0, 0.0, 0.0)


def test_folders():
    assert K.local_folder("file:///a%20b/c") == K.local_folder("/a b/c") == "/a b/c"
    with pytest.raises(ValueError):
        K.local_folder("hdfs://host/a")


def test_query_beats_single_words(spark):
    got = registry.op13_lm_scoring(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == got.doc_id.map(held_out)).all() and got.train_tokens.nunique() == 1
    assert got.n_tokens[~got.held_out].sum() == got.train_tokens[0]
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
