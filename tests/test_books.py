"""Rule books as they are written: loaded with what they extend, made ready, and run over payloads."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from millrace.operators import engine
from millrace.sources.books import written_book
from millrace.sources.readers import load_book, merge_books

BASE = """
sap_defaults: {AUART: ZX}
field_specs: {AUART: {max_len: 4}, SHIP: {}, PO: {max_len: 35}, BRAND: {}, CUR: {}, COND: {}, KIND: {}, QTY: {type: decimal, role: quantity}, PACK: {}, HEAD: {}}
fields:
  AUART: {from: base}
  CUR: {from: rule, rule: currency}
  COND: {from: rule, rule: condition}
  QTY: {from: doc, path: line.quantity, format: integer, required: true, nonzero: warn}
rules:
  currency: {kind: csv_map, source: header.currency_text, table_file: currency.csv, key_column: text, value_column: code, mode_column: match, case_insensitive: true, on_no_match: {action: empty}}
  condition: {kind: csv_choice, table_file: shipping.csv, filter_column: customer, value_column: cond, on_many: {action: warn, message: "{count} rows"}, on_no_match: {action: empty}}
"""
OWN = """
extends: [base]
meta: {code: OWN, customer_no: "7"}
tables:
  routing:
    when: [{source: shipment.ship_to_text, fallback_source: header.ship_to_text, op: contains_ci}]
    then: [SHIP, _city, _pack]
    rows:
      - {when: ["lakeside"], then: ["11", "LAKE", "L"]}
      - {when: ["hillside"], then: ["22", "HILL", "H"]}
      - {when: ["a", "b"], then: ["99", "BAD", "B"]}
    on_no_match: {action: warn, message: "no city"}
rules:
  brand: {kind: keyword_map, source: header.brand_text, fallback_source: header.order_text, case_insensitive: true, entries: [{equals: skipped, value: "0"}, {contains: "ACME", value: "038"}]}
  strict: {kind: keyword_map, source: header.brand_text, entries: [{contains: "ACME", value: "1"}], on_no_match: {action: default, value: "-"}}
  colours: {kind: lookup, table_file: colours.csv, key: line.our_item, key_column: item, return: [ring, mark], on_no_match: {action: error, message: "no colour"}}
  head: {kind: regex_extract, source: header.po_number, pattern: "^([A-Z]+)-"}
  broken: {kind: regex_extract, source: header.po_number, pattern: "("}
fields:
  SHIP: {from: table, table: routing, required: warn}
  PO: {from: expr, expr: 'if(_city, concat(header.po_number, "(", _city, ")"), header.po_number)'}
  BRAND: {from: rule, rule: brand, required: warn}
  KIND: {from: expr, expr: 'if(in(field.BRAND, ["038"]), "A", "B")'}
  PACK: {from: expr, expr: 'join(",", compact([_pack, colours.ring, colours.mark, strict, broken]))'}
  HEAD: {from: rule, rule: head}
checks: [{id: shipment_total_match, severity: warn}]
"""
TABLES = {
    "currency.csv": [("Canadian Dollar", "CAD", ""), ("US", "USD", "equals"), ("Dollar", "USD", "contains")],
    "shipping.csv": [("7", "A"), ("7", "B"), ("8", "C"), ("7", "A")],
    "colours.csv": [("i1", "Blue", "3"), ("i1", "Red", "4"), ("i2", "", "5")],
}
NAMES = {"currency.csv": ("text", "code", "match"), "shipping.csv": ("customer", "cond"), "colours.csv": ("item", "ring", "mark")}


@pytest.fixture(scope="module")
def built(spark):
    def reference(file, optional):
        rows = [(*r, i) for i, r in enumerate(TABLES[file])]
        return spark.createDataFrame(rows, [*NAMES[file], "_ord"])

    value = lambda x: {"value": x}
    line = lambda item, qty: {"our_item": value(item), "quantity": value(qty)}
    one = {"header": {"po_number": value("PO-1"), "currency_text": value("canadian dollars"), "brand_text": value("acme tools")}, "totals": {"total_qty": "6"}}
    one["shipments"] = [{"ship_to_text": value("Lakeside Warehouse"), "lines": [line("i1", "1"), line("i2", "0")]}, {"ship_to_text": value("nowhere"), "lines": [line("i9", "5")]}]
    two = {"header": {"po_number": value("PO-2"), "currency_text": value("us"), "ship_to_text": value("HILLSIDE")}, "lines": [line("i2", "3")]}
    payloads = spark.createDataFrame([("d1", json.dumps(one)), ("d2", json.dumps(two)), ("d3", "{broken")], "doc_id string, payload string")
    book = written_book(load_book({"base": BASE, "own": OWN}, "own"), reference)
    return {(r["doc_id"], r["row_id"]): r for r in engine.build(engine.parse_payload(payloads), book).collect()}


def test_fields(built):
    fields = lambda k: tuple(built[k][c] for c in ("AUART", "SHIP", "PO", "BRAND", "CUR", "COND", "KIND", "QTY", "PACK", "HEAD"))
    assert set(built) == {("d1", "r_0001"), ("d1", "r_0002"), ("d1", "r_0003"), ("d2", "r_0001")}
    assert fields(("d1", "r_0001")) == ("ZX", "11", "PO-1(LAKE)", "038", "CAD", "", "A", "1", "L,Blue,3,-", "PO-")
    assert fields(("d1", "r_0002")) == ("ZX", "11", "PO-1(LAKE)", "038", "CAD", "", "A", "0", "L,5,-", "PO-")
    assert fields(("d1", "r_0003")) == ("ZX", "", "PO-1", "038", "CAD", "", "A", "5", "-", "PO-")
    assert fields(("d2", "r_0001")) == ("ZX", "22", "PO-2(HILL)", "", "USD", "", "B", "3", "H,5,-", "PO-")


def test_issues(built):
    issues = lambda k: sorted((i["code"], i["severity"], i["message"] if i["code"].endswith("NO_MATCH") else i["field"]) for i in built[k]["issues"])
    assert issues(("d1", "r_0001")) == [("RULE_NO_MATCH", "error", "broken"), ("RULE_NO_MATCH", "warn", "2 rows")]
    assert ("ZERO", "warn", "QTY") in issues(("d1", "r_0002"))
    third = issues(("d1", "r_0003"))
    assert ("TABLE_NO_MATCH", "warn", "no city") in third and ("RULE_NO_MATCH", "error", "no colour") in third and ("REQUIRED_MISSING", "warn", "SHIP") in third
    assert ("RULE_NO_MATCH", "warn", "brand") in issues(("d2", "r_0001")) and ("REQUIRED_MISSING", "warn", "BRAND") in issues(("d2", "r_0001"))


def test_merging():
    base = yaml.safe_load("{a: {x: 1, y: {z: 2}}, l: [1, 2], fields: {F: {from: const, value: 1}, G: {from: doc}}, s: 1, m: {k: 1}}")
    own = yaml.safe_load("{a: {y: {w: 3}}, l: [3], fields: {F: {from: table}}, s: {t: 1}, m: 5, e: {}}")
    want = {"a": {"x": 1, "y": {"z": 2, "w": 3}}, "l": [3], "fields": {"F": {"from": "table"}, "G": {"from": "doc"}}, "s": {"t": 1}, "m": 5, "e": {}}
    assert merge_books(base, own) == want and merge_books(base, {"a": {}}) == base


def test_dates_and_numbers_in_lines(spark):
    from millrace.operators.anchors import anchor

    cases = [
        ("2026-03-05", "due 3/5/26 ok", "date"), ("2026-03-05", "due 05.03.2026", "date"), ("20260305", "on 5th march 2026", "date"), ("2026-03-05", "5-mar-26", "date"), ("2026-03-05", "march 05, 2026", "date"),
        ("2026-09-01", "sept 1, 2026", "date"), ("2026-03-05", "3 may 12 2024", "fuzzy"), ("2024-05-12", "3 may 12 2024", "date"), ("2026-03-05", "x3/5/26", "fuzzy"), ("2026-03-05", "260305", "date"), ("2026-03-05", "5 mar. 2026", "fuzzy"),
        ("12", "no 112 12.", "exact"), ("12", "112", "miss"), ("12", "12.5", "fuzzy"), ("55", "5555", "miss"), ("1234.5", "1,234.50", "numeric"), ("1234.5", "1.234,5", "numeric"), ("a1", "xa1b a12", "exact"), ("5", "a 55", "miss"), ("$1,000", "1.000", "numeric"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", anchor(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [(cases[r["i"]][:2], r["r"]) for r in rows] == [((a, b), w) for a, b, w in cases]


@pytest.mark.parametrize("source", ["concat('a',)", "[1,]", "null.x", "a\nb", "'a\\n'", "a.", "", "a b", "f(", "concat('a', ['b'])"])
def test_expressions_that_are_refused(spark, source):
    from millrace.functions import expr

    with pytest.raises(expr.ExprError):
        expr.compile_expr(source, lambda path: None)


def test_blanks_around_dots():
    from millrace.functions import expr

    assert expr.paths(expr.parse("concat(header . x,\tline.y)")) == ["header.x", "line.y"]
