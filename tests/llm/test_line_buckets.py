"""Lines that meet in large buckets: few pairs are left to verify, and none that is alike is ruled out."""

import random

from millrace.llm import line_dedup, linking

from test_line_recall import brute, changed, edits, found


def test_few_pairs_of_a_large_bucket(spark, monkeypatch):
    """300 unlike lines share two long words and draw the rest from fifty words; ten have a near copy. All pairs of one bucket are looked at, few are verified."""
    rng = random.Random(11)
    lines = [" ".join(["commonwordaaaa", "commonwordbbbb"] + [f"w{rng.randrange(50)}" for _ in range(20)]) for _ in range(300)]
    lines += [" ".join(changed(rng, x.split(), 1)) for x in lines[:10]]
    made, every_pair = [], linking.every_pair

    def counted(*args):
        pairs = every_pair(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(linking, "every_pair", counted)
    got, (want, pairs) = found(spark, lines), brute(lines)
    assert len(pairs) >= 10 and got == want
    assert sum(made) < 300, made


def test_marks_rule_out_no_alike_pair(spark):
    rng = random.Random(5)
    lines, pairs = [], []
    for n in (5, 9, 10, 30, 100, 300):
        for _ in range(20):
            base = [f"w{rng.randrange(50 * n)}" for _ in range(n)]
            pairs.append((len(lines), len(lines) + 1, n))
            lines += [" ".join(base), " ".join(changed(rng, base, n // 5))]
    docs = spark.createDataFrame(list(enumerate(lines)), "item long, line string")
    codes = docs.select("item", line_dedup.word_codes(line_dedup.word_keys(docs["line"])).alias("codes"))
    items = line_dedup.word_marks(codes).join(codes.selectExpr("item", "size(codes) AS words"), "item")
    x, y = items.selectExpr("item AS a", "struct(*) AS x"), items.selectExpr("item AS b", "struct(*) AS y")
    kept = {(r["a"], r["b"]) for r in x.crossJoin(y).filter("a < b").filter(line_dedup.may_be_alike(0.8)(x["x"], y["y"])).select("a", "b").collect()}
    alike = {(a, b) for a, b, n in pairs if edits(lines[a].split(), lines[b].split(), n) * 5 <= max(len(lines[a].split()), len(lines[b].split()))}
    assert len(alike) >= 60 and alike <= kept
    assert len(kept) < 2 * len(pairs)
