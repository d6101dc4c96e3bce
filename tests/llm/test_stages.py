"""The pipeline's stages on columns of any name and on empty tables; scans and shards against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, line_dedup, mixing, near_dedup, quality, sharding, spotsigs

HELPERS = "row_id row_text row_hash row_nth row_parts row_length row_take gone _id _gone _text _hash _nth _words _size _take hub label bucket item".split()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def clashing(documents):
    """The documents with further columns that are called like helpers, each telling its row."""
    return documents.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in HELPERS])


STAGES = {"quality": quality.keep_quality, "lines": line_dedup.deduplicate_lines, "near": near_dedup.drop_near_duplicates, "mix": mixing.mix_rows}


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns_keep_their_values(documents, clashing, name):
    got = STAGES[name](clashing)
    assert got.columns[: len(clashing.columns)] == clashing.columns
    rows = [r.asDict() for r in got.collect()]
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in HELPERS)
    plain = sorted((r["doc_id"], r["text"] or "") for r in STAGES[name](documents).collect())
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == plain


@pytest.mark.parametrize("name", [*STAGES, "groups"])
def test_empty_tables(documents, name):
    stage = STAGES.get(name, spotsigs.near_groups)
    assert stage(documents.filter("false")).count() == 0


def test_shards_are_near_equal(documents):
    """Law `bytes`: shards differ by no more than the largest group of equal texts and one cell of small ones."""
    rows = sharding.shard(documents).collect()
    size, group = {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        group[r["text_crc32"]] = group.get(r["text_crc32"], 0) + r["size"]
    assert {r["law"] for r in rows} == {"bytes"} and max(size.values()) <= sum(size.values()) / 16 + 2 * max(group.values())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_license_scan_against_all_windows(spark):
    """Edited notices: something is found in a text just where some stretch of it, of any place and length, matches some template."""
    rng = random.Random(11)
    templates = tuple(t for t in licenses.TEMPLATES if len(t[1]) < 90)[:8]
    filler = "of the a text with some words that say nothing here now version license public".split()
    texts = []
    for _ in range(60):
        words = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(filler)]
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(6)) + words + rng.choices(filler, k=rng.randrange(6))))
    prepared = [(licenses.template_words(t), licenses.places(licenses.template_words(t).tolist(), n)) for n, t in templates]

    def matched(text):
        words = licenses.template_words(text).tolist()
        for template, keys in prepared:
            n = len(template)
            for a in range(len(words)):
                pairs = licenses.aligned(words[a : a + int(n * licenses.STRETCH)], template.tolist())
                of = {j: i for i, j in pairs}
                if len(pairs) >= licenses.COVERAGE * n - 1e-9 and all(any(all(j in of and of[j] - j == of[k[0]] - k[0] for j in k) for k in spots) for spots in keys):
                    return True
        return False

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: bool(r["matches"]) for r in licenses.scan_licenses(docs, templates).collect()}
    want = {i: matched(t) for i, t in enumerate(texts)}
    assert sum(want.values()) > 10 and sum(not w for w in want.values()) > 5 and got == want
