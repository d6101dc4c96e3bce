"""Rows with a null doc_id."""

from collections import Counter

from millrace.llm import line_dedup, mixing


def test_null_ids_are_mixed(spark):
    rows = [(1, "a b c", "x"), (None, "d e f", "x"), (None, "g h i", "x"), (None, "g h i", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix_rows(docs, shards=2, blocks=8).collect())
    assert got == Counter({(1, "a b c"): 1, (None, "d e f"): 1, (None, "g h i"): 2})


def test_null_ids_stand_last(spark):
    rows = [(None, "same old line"), (5, "same old line"), (6, "first\nsame old line")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: "same old line", 5: "same old line", 6: "first"}
