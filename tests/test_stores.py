"""Stored responses, replacements that are checked first, hints, halved chunks, and maps by grams, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, documents, hints, rules
from millrace.sources import readers, sinks


def test_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    kind = "key string, payload string, stop_reason string, model string"
    first = spark.createDataFrame([("aa1", "p1", None, "m"), ("aa1", "p0", None, "m"), ("bb2", "p2", "max_tokens", "m"), ("cc3", "p3", "end", "m")], kind)
    sinks.save_responses(first, path)
    read = lambda: sorted((r.key, r.payload) for r in spark.read.parquet(path).collect())
    assert read() == [("aa1", "p0"), ("cc3", "p3")]
    sinks.save_responses(first, path)
    assert read() == [("aa1", "p0"), ("cc3", "p3")]
    sinks.save_responses(spark.createDataFrame([("aa1", "other", None, "m"), ("bb2", "p2", None, "m")], kind), path)
    assert read() == [("aa1", "p0"), ("bb2", "p2"), ("cc3", "p3")]


def test_response_keys_and_names(spark):
    import hashlib

    rows = spark.createDataFrame([("text", "lines", "v1", "MSC", "m"), (None, "lines", "v1", "MSC", "m")], "a string, b string, c string, d string, e string")
    got = {r.a: r.k for r in rows.select("a", readers.response_key(*map(F.col, "abcde")).alias("k")).collect()}
    assert got == {t: hashlib.sha256("\0".join([t or "", "lines", "v1", "MSC", "m"]).encode()).hexdigest() for t in ("text", None)}
    name = rows.select(readers.response_name(F.lit("MSC"), F.lit("in/P 80 (1).HTM"), "c3")).first()[0]
    assert name == "msc__P_80_1_.HTM__c3.json"


def test_replacement_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    kind = "place int, kunnr string, cond string, kind string"
    table = lambda rows: spark.createDataFrame(rows, kind)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).collect())
    limits = {"cond": 4}
    sinks.replace_table(table([(1, "A", "x", ""), (2, "B", "y", ""), (3, "", None, " "), (4, "C", "", "")]), path, "kunnr", limits)
    assert read() == [("A", "x", ""), ("B", "y", "")]
    for bad in ([(1, "A", "fine", ""), (2, "B", "too long", "")], [(1, "A", "x", ""), (2, "A", "y", "")], [(1, "", "x", "")]):
        with pytest.raises(sinks.Refused):
            sinks.replace_table(table(bad), path, "kunnr", limits)
        assert read() == [("A", "x", ""), ("B", "y", "")]
    with pytest.raises(sinks.Refused, match="other_scope B"):
        sinks.replace_table(table([(1, "B", "z", "")]), path, "kunnr", limits, scope="A")
    sinks.replace_table(table([(1, " A ", "z", "k")]), path, "kunnr", limits, scope="A")
    assert read() == [("A", "z", "k"), ("B", "y", "")]
    sinks.replace_table(table([]), path, "kunnr", limits, scope="A")
    assert read() == [("B", "y", "")] and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_hints(spark):
    text = 'Look at "PO NUMBER:  10972" and "Vendor No".\nex) "ACME  corp" "zz"\n예시: "none"\n"vendor no" "PO NUMBER:  10972" "ab" "Missing label"\r"12,5"'
    books = spark.createDataFrame([("A", text), ("B", None), ("C", '"Nothing here"')], "customer string, hints string")
    rows = [("d1", "A", "po   number : 1\nVENDOR NO 5 acme corp vendor no", True), ("d2", "A", "x", False), ("d3", "B", "x", True), ("d4", "C", None, True), ("d5", "D", "x", True)]
    got = {r.doc_id: (r.verdict, r.found, r.partial, r.missing, r.examples) for r in hints.check_hints(spark.createDataFrame(rows, "doc_id string, customer string, text string, has_text boolean"), books).collect()}
    assert got["d1"] == ("some_missing", ["Vendor No", "vendor no"], ["PO NUMBER:  10972"], ["Missing label", "12,5"], ["ACME  corp"])
    assert {d: got[d][0] for d in ("d2", "d3", "d4", "d5")} == {"d2": "scan", "d3": "no_hints", "d4": "none_found", "d5": "no_hints"}


def test_pieces(spark):
    chunks = spark.createDataFrame([("d", 1, i, s, e, r) for i, (s, e, r) in enumerate([(1, 10, 13), (11, 20, None), (21, 21, None), (22, 29, None)])], "doc_id string, ship_idx int, chunk_index int, start int, end int, read_end int")
    states = {(1, 10): "truncated", (1, 5): "ok", (6, 10): "truncated", (6, 8): "truncated", (9, 10): "ok", (11, 20): "ok", (21, 21): "truncated", (22, 29): "failed", (22, 25): "ok"}
    answers = spark.createDataFrame([("d", a, b, s) for (a, b), s in states.items()], "doc_id string, start int, end int, state string")
    pieces = documents.read_pieces(chunks, answers, tail=4)
    got = sorted((r.start, r.end, r.tail_end, r.failed) for r in pieces.collect())
    assert got == [(1, 5, 9, False), (6, 8, 12, True), (9, 10, 13, False), (11, 20, 20, False), (21, 21, 21, True), (22, 29, 29, True)]
    items = [(1, 5, [2, 6, 2, None]), (9, 10, [9, 11, 13, 14]), (22, 25, [23])]
    rows = spark.createDataFrame([("d", a, b, p, s) for a, b, srcs in items for p, s in enumerate(srcs)], "doc_id string, start int, end int, pos int, src int")
    lines, issues = documents.merge_pieces(pieces, rows)
    assert sorted((r.line_no, r.src, r.lo, r.hi) for r in lines.collect()) == [(1, 2, 1, 9), (2, None, 1, 9), (3, 9, 9, 13), (4, 14, 9, 13)]
    assert sorted((r.start, r.code) for r in issues.collect()) == [(1, "DUPLICATE_LINE"), (6, "CHUNK_FAILED"), (11, "EMPTY_CHUNK"), (21, "CHUNK_FAILED"), (22, "CHUNK_FAILED")]


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("few", [0, 10_000])
def test_map_by_grams(spark, monkeypatch, longest, few):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abß日E ") for _ in range(n))
    needles = [(i, draw.choice(["x", "y", None]), word(draw.randrange(0, 7)), f"v{i}", draw.choice(["equals", "contains", None])) for i in range(120)] + [(200, "x", None, "none", None), (201, "x", "aB", "first", "contains"), (202, "x", "Ab", "second", "contains")]
    sources = [word(draw.randrange(0, 30)) for _ in range(150)] + [None, "", "ab", "ab", "a" * 3000 + "日E"]
    sources += [n for _, _, n, _, m in needles if m == "equals"]
    monkeypatch.setattr(rules, "FEW_ENTRIES", few)
    fold = lambda t: t.lower().replace("ß", "ss")

    def first(source):
        if source is None:
            return None
        mine = [(-len(n) if longest else 0, i, n, v, m) for i, f, n, v, m in needles if (f or "") == "x" and n]
        return next((v for _, _, n, v, m in sorted(mine, key=lambda e: e[:2]) if (fold(n) == fold(source) if m == "equals" else fold(n) in fold(source))), None)

    table = spark.createDataFrame(needles, "_ord int, f string, n string, v string, m string")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "id int, s string").repartition(3)
    out = rules.csv_map_table(rows, table, F.col("s"), "got", "n", "v", "f", "x", "m", longest, insensitive=True)
    assert sorted((r.id, r.got or "") for r in out.collect()) == [(i, first(s) or "") for i, s in enumerate(sources)]


def test_batches_keep_failures_apart(spark):
    files = [("b", "f1", 1, None), ("b", "f2", 2, "gone"), ("b", "f3", 3, None), ("b", "f4", 4, None), ("b", "f5", 5, None), ("c", "f6", 1, None), ("c", "f7", 2, None)]
    two = {"lines": [{"item_code": "AB-1", "quantity": "5", "src": 1}, {"item_code": "AB-1", "quantity": "x", "src": 9}], "totals": {"total_qty": 5, "line_count": 2}}
    sent = [("f1", json.dumps(two)), ("f2", json.dumps(two)), ("f3", "{"), ("f5", json.dumps(two)), ("f6", json.dumps({"header": {"po_number": {"value": "1", "src": 7}}, "lines": [], "totals": {"line_count": 4}})), ("f7", '{"lines": [{"quantity": "1"}]}')]
    docs = [(f, ["AB-1 of 5"], f != "f7", True) for f in ("f1", "f5", "f6", "f7")]
    book = {"fields": {"QTY": {"from": "doc", "path": "line.quantity", "format": "integer"}}, "field_specs": {"QTY": {"required": True}}}
    rows, states = batches.parse_batch(
        spark.createDataFrame(files, "batch_id string, file_id string, place int, error string"), spark.createDataFrame(sent, "file_id string, payload string"),
        spark.createDataFrame(docs, "file_id string, lines array<string>, has_text boolean, anchored boolean"), book,
    )
    got = sorted((r.batch_id, r.row_id, r.file_id, sorted((i.field, i.code) for i in r.issues)) for r in rows.collect())
    bad = sorted([("QTY", "FORMAT_ERROR"), ("item_code", "EVIDENCE_NOT_FOUND"), ("quantity", "EVIDENCE_NOT_FOUND")])
    assert got == [("b", "r_0001", "f1", []), ("b", "r_0002", "f1", bad), ("b", "r_0003", "f5", []), ("b", "r_0004", "f5", bad), ("c", "r_0001", "f7", [])]
    state = {r.file_id: (r.status, r.error, r.row_count) for r in states.collect()}
    assert state == {
        "f1": ("DONE", "", 2), "f2": ("FAILED", "gone", 0), "f3": ("FAILED", "the payload is no JSON object", 0), "f4": ("FAILED", "the payload is no JSON object", 0), "f5": ("DONE", "", 2),
        "f6": ("FAILED", "header.po_number: EVIDENCE_NOT_FOUND / totals.line_count: TOTAL_MISMATCH / lines: NO_LINES", 0), "f7": ("DONE", "", 1),
    }
