"""Grounding of values, and edits of rows as a whole."""

from millrace.operators.edits import apply_edits
from millrace.operators.engine import ISSUE
from millrace.operators.grounding import ground


def test_ground(spark):
    lines = ["===== PAGE 1 =====", "order 4711 of 3/5/26", "item AB-1234 big red ring", "qty 12 pcs"]
    docs = spark.createDataFrame([("d", lines, True, True), ("scan", lines, False, True), ("free", lines, True, False)], "doc_id string, lines array<string>, has_text boolean, anchored boolean")
    cases = [  # path, value, src, src_end, confidence, required, part, lo, hi
        ("ok", "4711", 2, None, 0.99, True, False, None, None), ("none", "4711", None, None, None, False, False, None, None), ("out", "12", 9, None, None, False, False, None, None),
        ("back", "12", 4, 3, None, False, False, None, None), ("miss", "4711", 3, None, 0.5, True, False, None, None), ("weak", "big red thing", 3, None, 0.8, False, False, None, None),
        ("chunk", "12", 4, None, None, False, False, 1, 3), ("part", "ab-1234", 3, None, None, False, True, None, None), ("fake", "big red ring x999", 3, None, None, False, True, None, None), ("blank", "  ", None, None, 0.1, True, False, None, None),
    ]
    kind = "doc_id string, path string, value string, src int, src_end int, confidence double, required boolean, part boolean, lo int, hi int"
    values = spark.createDataFrame([(d, *c) for d in ("d", "scan", "free") for c in cases], kind)
    got = {(r["doc_id"], r["path"], r["level"], r["code"]) for r in ground(values, docs).collect()}
    wrong = {("d", p, "error", "EVIDENCE_NOT_FOUND") for p in ("none", "out", "back", "miss", "chunk", "fake")} | {("d", "weak", "warn", "EVIDENCE_WEAK")}
    unsure = {(d, p, level, "LOW_CONFIDENCE") for d in ("d", "scan", "free") for p, level in (("miss", "error"), ("weak", "warn"))}
    assert got == wrong | unsure


def test_edits(spark):
    book = {
        "fields": {"A": {"from": "doc"}, "B": {"from": "expr", "expr": "if(field.A, concat(field.A, '!'), '')"}, "C": {"from": "const"}},
        "field_specs": {"A": {"required": True}, "B": {"max_len": 3}, "C": {}},
    }
    issue = lambda field, code: (field, "warn", code, code)
    rows = [
        ("r1", "x", "x!", "", "x", "x!", "", False, [], [issue("A", "CHUNK_FAILED"), issue("C", "LIKELY_MISSED"), issue("A", "ZERO")]),
        ("r2", "x", "mine", "", "x", "x!", "", False, ["B"], [issue("C", "LIKELY_MISSED")]),
        ("r3", "x", "x!", "", "x", "x!", "", False, [], [issue("C", "LIKELY_MISSED")]),
        ("r4", "x", "odd", "", "x", "odd", "", False, [], [issue("A", "ZERO")]),
    ]
    kind = f"row_id string, A string, B string, C string, A_original string, B_original string, C_original string, deleted boolean, manual array<string>, issues array<{ISSUE}>"
    edits = [("r1", "long", None, None), ("r2", "", "c", None), ("r3", None, None, True), ("r9", "y", None, None)]
    out, unknown = apply_edits(spark.createDataFrame(rows, kind), spark.createDataFrame(edits, "row_id string, A string, C string, deleted boolean"), book)
    got = {r["row_id"]: (r["A"], r["B"], r["C"], r["manual"], r["edited"], sorted(i["code"] for i in r["issues"]), r["deleted"]) for r in out.collect()}
    assert got == {
        "r1": ("long", "long!", "", ["A"], ["A", "B"], ["CHUNK_FAILED", "LIKELY_MISSED", "TOO_LONG"], False),
        "r2": ("", "mine", "c", ["A", "B", "C"], ["A", "B", "C"], ["REQUIRED_MISSING", "TOO_LONG"], False),
        "r3": ("x", "x!", "", [], [], [], True),
        "r4": ("x", "odd", "", [], [], ["ZERO"], False),
    }
    assert [r["row_id"] for r in unknown.collect()] == ["r9"]
