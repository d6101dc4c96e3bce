"""Line dedup against brute force over all pairs of lines, by edits and line length."""

import random
import re
from collections import defaultdict

from millrace.llm import line_dedup


def norm(line):
    return " ".join(re.sub(r"[\W_]", " ", line.lower()).split())


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        if min(row) > most:
            return most + 1
    return row[-1]


def brute(lines):
    """The first line of each line's group, by single linkage at edit similarity 0.8 over words, and the linked pairs."""
    words = [norm(x).split() for x in lines]
    up = list(range(len(lines)))
    pairs = []

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            most = max(len(words[i]), len(words[j])) // 5
            if min(len(words[i]), len(words[j])) >= 5 and edits(words[i], words[j], most) <= most:
                pairs.append((j, i))
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(lines))], pairs


def found(spark, lines):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["first_doc"] for r in line_dedup.line_classes(docs).collect()}
    return [got.get(i, i) for i in range(len(lines))]


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"more{rng.randrange(10**6)}")
        else:
            del out[at]
    return out


def test_recall_by_length_and_edits(spark):
    """Of all linked pairs, nine of ten at least are found at each length and number of edits, and none that aren't linked."""
    rng = random.Random(7)
    vocabulary = [f"{rng.choice(['ta', 'retta', 'mo', 'kirimo'])}{i}" for i in range(3000)]
    lines, kind = [], {}
    for n in (5, 6, 10, 20, 50):
        for k in sorted({1, n // 10, n // 5} - {0}):
            for _ in range(60 if n < 50 else 30):
                base = [rng.choice(vocabulary) for _ in range(n)]
                kind[len(lines)] = (n, k)
                lines += [" ".join(base), " ".join(changed(rng, base, k))]
    got, (want, pairs) = found(spark, lines), brute(lines)
    hits = defaultdict(list)
    for a, b in pairs:
        hits[kind[a]].append(got[a] == got[b])
    assert len(pairs) > 400
    for key, h in hits.items():
        assert sum(h) >= 0.9 * len(h), (key, sum(h), len(h))
    assert all(want[i] == want[g] for i, g in enumerate(got))


def test_one_word_of_twenty(spark):
    """Far copies of one line: all of them are of one group through the line that they come from."""
    rng = random.Random(3)
    base = [f"content{i}" for i in range(20)]
    lines = [" ".join(base)] + [" ".join(changed(rng, base, 1 + i % 3)) for i in range(100)]
    assert found(spark, lines) == brute(lines)[0]


def test_two_words_of_ten(spark):
    base = [f"content{i}" for i in range(10)]
    lines = [" ".join(base)]
    for i in range(10):
        for j in range(i):
            lines.append(" ".join(f"other{i}x{j}x{k}" if k in (i, j) else w for k, w in enumerate(base)))
    assert found(spark, lines) == [0] * 46


def test_repetitive_lines(spark):
    """Lines of few different words: nothing is merged that brute force doesn't merge."""
    rng = random.Random(5)
    lines = [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randrange(5, 12))) for _ in range(40)]
    lines += ["ha " * 10, "ha " * 12, "ha " * 9 + "no", "a " * 7, "a a x a a y a"]
    want, _ = brute(lines)
    assert all(want[i] == want[g] for i, g in enumerate(found(spark, lines)))


def test_short_words_unspaced_scripts_and_long_lines(spark):
    short = "we go to the sea on a big old bus"
    long = [f"word{i}" for i in range(4000)]
    lines = [short, short.replace("big", "red"), "今日は天気がとても良いです", "今日は天気がとても悪いです", " ".join(long), " ".join(long[:2000] + ["changed"] + long[2001:])]
    assert len(lines[4]) > 10_000
    assert found(spark, lines) == [0, 0, 2, 2, 4, 4]


def test_columns_of_any_name(spark):
    """Columns called like helpers of the operator keep their values."""
    docs = spark.createDataFrame([(1, "a b c d e f\nx", 10, 20, 30), (2, "a b c d e g\ny", 11, 21, 31)], "doc_id long, text string, row_id int, gone int, _id int")
    got = [tuple(r) for r in line_dedup.deduplicate_lines(docs).orderBy("doc_id").collect()]
    assert got == [(1, "a b c d e f\nx", 10, 20, 30, 2, 0), (2, "y", 11, 21, 31, 2, 1)]
