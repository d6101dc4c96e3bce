"""The row engine on literal rows: expressions, formats, rules, a whole document, edits."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import expr as X
from millrace.functions.formats import apply_format
from millrace.functions.text import casefold, java_regex, pad_left, strip
from millrace.operators import anchors, documents, engine, references, review, rules
from millrace.sources import readers
from millrace.sources.html import text_of


def evaluate(spark, source, **paths):
    row = spark.createDataFrame([tuple(paths.values()) or ("",)], ", ".join(f"`{p.replace('__', '.')}` string" for p in paths) or "x string")
    v = X.compile_expr(source, lambda p: F.col(f"`{p}`") if p.replace(".", "__") in paths else None)
    r = row.select(X.as_text(v).alias("v"), v.error.alias("e")).first()
    return "ERROR" if r["e"] else r["v"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("concat('a', null, 'b', 3, true, false)", "ab3true"), ("join('-', ['a', null, ''])", "a--"), ("join('-', compact(['a', null, '', 'b']))", "a-b"),
        ("coalesce('', null, '0', 'x')", "0"), ("if('', 'yes', 'no')", "no"), ("if('0', 'yes', 'no')", "yes"), ("if(true, 'ok', integer('x'))", "ok"),
        ("if(false, 'ok', integer('x'))", "ERROR"), ("contains('abc', 'B')", ""), ("in('b', ['a', 'b'])", "true"), ("replace('aaa', '', 'x')", "xaxaxax"),
        ("replace('a.a', '.', '-')", "a-a"), ("substr('abcdef', 1, 3)", "bcd"), ("substr('abcdef', -2, 2)", ""), ("substr('abc', 1, 99)", "bc"),
        ("pad('7', 3, '0')", "007"), ("pad('abcdef', 3, '0')", "abcdef"), ("pad('7', 3, '')", "  7"), ("trim('  x ')", "x"), ("integer('1,250')", "1250"),
        ("integer('')", ""), ("integer('2.5')", "ERROR"), ("decimal3('2.0005')", "2.000"), ("decimal3('2.0015')", "2.002"), ("date_yyyymmdd('2/17/26')", "20260217"),
        ("date_yyyymmdd('17/2/26')", "20260217"), ("date_yyyymmdd('20260231')", "20260231"), ("header.x", "v"), ("no.such.path", ""), ("upper('aß')", "ASS"),
    ],
)
def test_expressions(spark, source, want):
    assert evaluate(spark, source, header__x="v") == want


@pytest.mark.parametrize("source", ["foo('a')", "concat()", "if('a')", "contains('a', ['b'])", "'open", "concat('a'", "a b", "'\\q'", "join('a', 'b')"])
def test_expressions_refused(source):
    with pytest.raises(X.ExprError):
        X.compile_expr(source, lambda p: None)


def test_lists_have_no_text_and_lint():
    with pytest.raises(X.ExprError):
        X.as_text(X.compile_expr("['a']", lambda p: None))
    assert X.lint(X.parse("contains('x', line.a)")) and not X.lint(X.parse("contains(line.a, 'x')"))
    assert X.paths(X.parse("concat(a.b, if(c.d, a.b, 'x'))")) == ["a.b", "c.d"]


def test_text_traps(spark):
    one = lambda *cols: tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first())
    assert one(strip(F.lit("\t　x y\x1c\n")), casefold(F.lit("STRAßE")), pad_left(F.lit("abcd"), 3), pad_left(F.lit("a"), 3)) == ("x y", "strasse", "abcd", "00a")
    assert java_regex(r"(?P<a>x)(?P=a)\Z") == r"(?U)(?<a>x)\k<a>\z"
    with pytest.raises(ValueError):
        java_regex(r"(a)(?(1)b|c)")
    value, failed = apply_format("strip_parens", F.lit("D11 (1pc)（두）"))
    assert one(value, failed) == ("D11", False)
    for bad in ("NaN", "Infinity", "1_000", "x"):
        assert one(*apply_format("integer", F.lit(bad))) == (bad, True)


def v(x, src=None):
    return {"value": x, "src": src, "src_end": src, "page": 1, "confidence": 0.95}


PAYLOAD = {
    "header": {"po_number": v("4500"), "po_date": v("2/17/26"), "currency_text": v(" usd "), "extra": {"zone": v("Z9")}},
    "lines": [{"description": v("ignored")}],
    "shipments": [
        {"shipment_no": v("S1"), "receiving_loc": v("ELK"), "lines": [{"description": v("Red mill"), "quantity": v("10")}, {"description": v("drill"), "quantity": v("15"), "extra": {"c": v("q")}}]},
        {"shipment_no": v("S2"), "lines": [{"description": v("tap"), "quantity": v("1,000.5")}, {"description": v("tap"), "quantity": v("2")}, {"description": v(""), "quantity": v("3")}]},
    ],
    "totals": {"line_count": 5, "total_qty": "999"},
}
BOOK = {
    "meta": {"customer_no": "100"},
    "base": {"AUART": "ZOR"},
    "tables": [{"name": "t", "columns": [{"source": "line.description", "op": "contains_ci"}], "rows": [{"when": ["RED"], "set": {"COLOR": "R", "_c": "red"}}], "on_no_match": {"action": "warn", "message": "{description}?"}}],
    "rules": {"loc": {"kind": "value_map", "source": "shipment.receiving_loc", "fallback_source": "shipment.shipment_no", "map": [{"equals": "ELK", "value": "1"}], "on_no_match": {"action": "error"}}},
    "fields": {
        "AUART": {"from": "base"}, "BSTKD": {"from": "doc", "path": "header.po_number"}, "POSEX": {"from": "gen"}, "COLOR": {"from": "table", "default": "none"},
        "KWMENG": {"from": "doc", "path": "line.quantity", "format": "integer"}, "LOC": {"from": "rule", "rule": "loc"}, "NAME": {"from": "doc", "path": "line.description", "format": "upper"},
        "ZONE": {"from": "expr", "expr": "concat(header.extra.zone, line.extra.c)"}, "SUM": {"from": "expr", "expr": "concat(field.LOC, '/', field.COLOR)"},
    },
    "field_specs": {"AUART": {}, "BSTKD": {"max_len": 3}, "POSEX": {}, "COLOR": {}, "KWMENG": {"nonzero": True}, "LOC": {"required": True}, "NAME": {"required": "warn"}, "ZONE": {}, "SUM": {}, "LOST": {}},
    "own_fields": ["NAME"],
    "validation": {"shipment_total_match": {"severity": "warn"}, "unknown_check": {}},
}


def test_whole_document(spark):
    docs = engine.parse_payload(spark.createDataFrame([("d1", json.dumps(PAYLOAD)), ("bad", "{")], "doc_id string, payload string"))
    got = engine.build(docs.filter("po IS NOT NULL").repartition(3), BOOK).orderBy("row_id").collect()
    assert [(r["row_id"], r["group"], r["line_no"], r["POSEX"]) for r in got] == [("r_0001", "ELK", 1, "000010"), ("r_0002", "ELK", 2, "000020"), ("r_0003", "S2", 1, "000010"), ("r_0004", "S2", 2, "000020"), ("r_0005", "S2", 3, "000030")]
    assert [r["COLOR"] for r in got] == ["R", "none", "none", "none", "none"] and [r["KWMENG"] for r in got] == ["10", "15", "1,000.5", "2", "3"]
    assert [r["SUM"] for r in got] == ["1/R", "1/none", "/none", "/none", "/none"] and got[1]["ZONE"] == "Z9q" and got[0]["LOST"] == ""
    codes = [[i["code"] for i in r["issues"]] for r in got]
    assert codes[0] == ["FIELD_NOT_DECLARED", "TOO_LONG", "TOTAL_MISMATCH"]
    assert codes[2] == ["TABLE_NO_MATCH", "RULE_NO_MATCH", "FORMAT_ERROR", "FIELD_NOT_DECLARED", "TOO_LONG", "REQUIRED_MISSING", "TOTAL_MISMATCH"]
    assert codes[4][-2:] == ["REQUIRED_MISSING", "TOTAL_MISMATCH"]  # the cell has an issue, so it isn't likely missed
    assert next(i["message"] for i in got[1]["issues"] if i["code"] == "TABLE_NO_MATCH") == "drill?"


def test_total_mismatch_and_likely_missed(spark):
    book = BOOK | {"field_specs": {k: {} for k in BOOK["fields"]}, "fields": BOOK["fields"] | {"KWMENG": {"from": "doc", "path": "line.quantity"}}}
    docs = engine.parse_payload(spark.createDataFrame([("d1", json.dumps(PAYLOAD))], "doc_id string, payload string"))
    got = engine.build(docs, book).orderBy("row_id").collect()
    assert all("TOTAL_MISMATCH" in [i["code"] for i in r["issues"]] for r in got)
    assert [i["field"] for i in got[4]["issues"] if i["code"] == "LIKELY_MISSED"] == ["NAME"]


def test_documents(spark):
    docs = spark.createDataFrame([("a", ["x\n\ny", "z"])], "doc_id string, pages array<string>")
    got = [(r["n"], r["page"], r["text"]) for r in documents.document_lines(docs).orderBy("n").collect()]
    assert got == [(1, 1, "===== PAGE 1 ====="), (2, 1, "x"), (3, 1, ""), (4, 1, "y"), (5, 2, "===== PAGE 2 ====="), (6, 2, "z")]
    blocks = spark.createDataFrame([("a", 1, 5, 14)], "doc_id string, ship_idx int, src int, src_end int")
    plan = [(r["start"], r["end"], r["read_end"], r["mid_block"]) for r in documents.chunk_plan(blocks, 4, 2).orderBy("part").collect()]
    assert plan == [(5, 8, 10, False), (9, 11, 13, True), (12, 14, None, True)]
    assert documents.line_limit(120, 16_000, 0.9, 80) == 120 and documents.line_limit(0, 1, 0.9, 80) == 1


@pytest.mark.parametrize(
    ("value", "line", "want"),
    [
        ("5", "qty 15", "miss"), ("5", "qty 5EA", "exact"), ("10", "10.5", "fuzzy"), ("10 mm", "x10.5", "miss"), ("1250", "total 1,250.00", "numeric"), ("1250.5", "1.250,50 EUR", "numeric"), ("2026-03-10", "on March 10th, 2026", "date"),
        ("2026-02-17", "12/17/26", "fuzzy"), ("2026-02-17", "ship 2/17/26", "date"), ("red steel mill", "a red mill", "fuzzy"), ("a b", "a c", "miss"), ("", "x", "miss"), (r"a\Eb (", r"x a\Eb ( y", "exact"),
    ],
)
def test_anchors(spark, value, line, want):
    assert spark.range(1).select(anchors.anchor(F.lit(value), F.lit(line))).first()[0] == want


def test_merge_keeps_null_sources(spark):
    rows = [("d", 1, 1, 1, 6, 7, 0, 3), ("d", 1, 1, 1, 6, 7, 1, None), ("d", 1, 2, 7, 9, None, 0, 3), ("d", 1, 2, 7, 9, None, 1, None), ("d", 1, 1, 1, 6, 7, 2, 7)]
    items = spark.createDataFrame(rows, "doc_id string, ship_idx int, chunk_index int, start int, end int, tail_end int, pos int, src int").repartition(4)
    assert [(r["line_no"], r["src"]) for r in documents.merge_chunks(items).orderBy("line_no").collect()] == [(1, 3), (2, None), (3, None)]


def test_html_and_books(tmp_path, spark):
    assert text_of("<p>a</p><script>x</script><table><tr><td>1 </td><td>b<br>c</td></tr><tr><td></td></tr></table>&amp;") == "a\n1 | b c\n&"
    base = "fields:\n  A: {from: const, value: 1}\n  B: {from: const, value: 2}\nlist: [1, 2]\nmeta: {x: 1, y: 2}\n"
    own = "extends: [base]\nfields:\n  A: {from: expr, expr: \"foo('a')\"}\nlist: [3]\nmeta: {y: 3}\nfield_specs: {A: {}, B: {}, C: {}}\n"
    book = readers.load_book({"base": base, "own": own}, "own")
    assert book["fields"]["A"] == {"from": "expr", "expr": "foo('a')"} and book["fields"]["B"]["value"] == 2 and book["list"] == [3] and book["meta"] == {"x": 1, "y": 3} and book["own_fields"] == ["A"]
    assert len(readers.book_problems(book)) == 2
    (tmp_path / "r.csv").write_text("﻿k, v\n a ,1\nb,\"x\ny\"\na,2\n", encoding="utf-8")
    ref = readers.read_reference(spark, str(tmp_path / "r.csv"))
    assert [tuple(r)[:2] for r in ref.orderBy("_ord").collect()] == [("a", "1"), ("b", "x\ny"), ("a", "2")]
    assert readers.read_reference(spark, str(tmp_path / "none.csv"), optional=True) is None
    hit = rules.lookup(spark.createDataFrame([("a",), ("",), ("q",)], "k0 string"), ref, F.col("k0"), "k", ["v"], "h")
    assert {r["k0"]: r["h"]["v"] for r in hit.collect()} == {"a": "1", "": "", "q": ""}


def test_overlay_places_adds(spark):
    master = spark.createDataFrame([("1", "A", "n", 1), ("2", "B", "n", 2), ("1", "C", "n", 3)], "kunnr string, zbrand string, name1 string, _ord int")
    manual = spark.createDataFrame([("1", "D", "m", "add", 1), ("3", "E", "m", "add", 2), ("2", "B", "x", "suppress", 3)], "kunnr string, zbrand string, name1 string, action string, _ord int")
    assert [r["zbrand"] for r in references.overlay(master, manual).orderBy("_ord").collect()] == ["A", "C", "D", "E"]


def test_stream(spark, tmp_path):
    from millrace.streaming.inbox import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"doc_id": "d1", "po": PAYLOAD}) + "\n")
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), BOOK).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_review(spark):
    issues = [("Q", "error", "A", "m"), ("Q", "warn", "A", "m"), ("P", "warn", "A", "m")]
    df = spark.createDataFrame([(issues,)], f"i array<{engine.ISSUE}>")
    assert [x["field"] for x in df.select(review.dedupe_issues(F.col("i"))).first()[0]] == ["Q", "P"]
    assert review.rule_book_view(BOOK, spark).count() == 1 + 1 + len(BOOK["fields"])
