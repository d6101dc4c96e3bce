"""What grounding does to each value is compiled code: no lambda judges which issues a value has."""

from millrace.operators.grounding import ground


def test_issues_are_not_filtered_by_a_lambda(spark):
    docs = spark.createDataFrame([("d", ["order 4711"], True, True)], "doc_id string, lines array<string>, has_text boolean, anchored boolean")
    kind = "doc_id string, path string, value string, src int, src_end int, confidence double, required boolean, part boolean, lo int, hi int"
    values = [("d", "both", "12", 1, None, 0.5, True, False, None, None), ("d", "none", "4711", 1, None, 0.95, True, False, None, None), ("d", "low", "4711", 1, None, 0.8, False, False, None, None)]
    found = ground(spark.createDataFrame(values, kind), docs)
    assert {tuple(r) for r in found.collect()} == {("d", "both", "error", "EVIDENCE_NOT_FOUND"), ("d", "both", "error", "LOW_CONFIDENCE"), ("d", "low", "warn", "LOW_CONFIDENCE")}
    assert "explode(filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
