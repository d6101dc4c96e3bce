"""Near copies of lines are found where most lines share a few long words, against brute force over all pairs."""

import random

import pytest

from millrace.llm import line_dedup

from test_line_recall import brute, found


@pytest.mark.parametrize("shared, own, letters", [(6, 25, (2, 5)), (7, 14, (5, 5)), (6, 10, (3, 6)), (6, 40, (2, 5))])
def test_lines_that_share_long_words(spark, shared, own, letters):
    rng = random.Random(own)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(*letters)))
    common = [f"commonword{chr(97 + i) * 4}" for i in range(shared)]
    lines = []
    for _ in range(100):
        mine = [word() for _ in range(own)]
        other = list(mine)
        other[rng.randrange(own)] = word()
        lines += [" ".join(common + mine), " ".join(common + other)]
    got, (want, pairs) = found(spark, lines), brute(lines)
    assert len(pairs) >= 95
    hits = sum(got[a] == got[b] for a, b in pairs)
    assert hits >= 0.95 * len(pairs), (hits, len(pairs))
    assert all(want[i] == want[g] for i, g in enumerate(got))


def test_codes_of_words(spark):
    """A word's code keeps its length class, and a line's string has one character for each word."""
    rows = spark.createDataFrame([("a bb ccc dddd eeeee ffffff ggggggg",), ("Über x",)], "line string")
    codes = rows.select(line_dedup.word_codes(line_dedup.word_keys(rows["line"])).alias("c"), line_dedup.word_string(line_dedup.word_codes(line_dedup.word_keys(rows["line"]))).alias("s"))
    one, two = codes.collect()
    assert [c // line_dedup.CODES for c in one["c"]] == [0, 1, 2, 3, 4, 5, 5] and len(two["s"]) == 2
    assert [ord(x) - 0x10000 for x in one["s"]] == one["c"]
