"""No link of near duplicates is lost where most of each text is common to all of them."""

import random

import pytest

from millrace.llm import near_dedup

K = 4


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + K]) for i in range(len(w) - K + 1)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("common, own, seed", [(175, 35, 1), (150, 60, 2)])
def test_pairs_over_a_common_text(spark, common, own, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    shared = [word() for _ in range(common)]
    rows = []
    for i in range(200):
        text = [*shared, *(word() for _ in range(own))]
        other = list(text)
        for at in draw.sample(range(common, common + own), 4):
            other[at] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    want = brute(rows)
    assert len(set(want.values())) < 400
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=K)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
