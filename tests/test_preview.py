"""Fixed values of a rule book, its field list and open points, and the generic book."""

from millrace.operators import preview, upkeep
from millrace.sources.books import generic_book, written_book
from millrace.sources.readers import load_book

BOOK = """
meta: {code: C, customer_no: "7"}
sap_defaults: {A: Z1, H: hidden}
field_specs: {A: {label: Type, code: AA, max_len: 4}, B: {}, D: {label: Doc}, E: {}, F: {}, G: {}, H: {send_only: true}}
fields:
  A: {from: base, explain: always}
  B: {from: const, value: "", todo: not known yet}
  D: {from: expr, expr: 'concat(meta.customer_no, "-", header.po_number)'}
  E: {from: expr, expr: 'concat("c", meta.customer_no)'}
  F: {from: rule, rule: cond}
  G: {from: rule, rule: none}
  H: {from: base}
rules:
  cond: {kind: csv_choice, preview: fixed, table_file: t, filter_column: k, value_column: v}
  none: {kind: csv_choice, preview: fixed, table_file: t, filter_column: k, value_column: w}
  map: {kind: value_map, source: header.x, entries: [{equals: a, value: b, todo: check}]}
"""


def test_fixed_values(spark):
    table = spark.createDataFrame([("7", "x", "", 0), ("8", "y", "", 1)], "k string, v string, w string, _ord int")
    book = written_book(load_book({"c": BOOK}, "c"), lambda file, optional: table)
    got = {r["field"]: (r["label"], r["title"], r["value"], r["note"]) for r in preview.fixed_values(spark, book).collect()}
    assert got == {"A": ("Type", "Type - AA", "Z1", "always"), "E": ("E", "E - E", "c7", None), "F": ("F", "F - F", "x", None), "G": ("G", "G - G", "", None)}
    assert preview.field_list(book)[0] == {"name": "A", "label": "Type", "code": "AA", "max_len": 4} and preview.field_list(book)[1] == {"name": "B", "label": "B"}
    assert list(preview.todos(book)) == [("B", "not known yet"), ("map", "b: check")]


def test_generic_book(spark):
    brands = spark.createDataFrame([("7", "", 0), ("7", "Seven", 1), ("7", "Later", 2), ("8", None, 3)], "kunnr string, name1 string, _ord int")
    texts = {"base": "fields: {A: {from: base}}"}
    book = generic_book(texts, "7", brands, ["base"])
    assert book["meta"]["name"] == "Seven" and book["meta"]["generic"] and book["fields"] == {"A": {"from": "base"}}
    assert generic_book(texts, "8", brands, ["base"])["meta"]["name"] == "8"
    try:
        generic_book(texts, "9", brands, ["base"])
    except ValueError as e:
        assert "9" in str(e)
    else:
        raise AssertionError


def test_column_order():
    grid = {"pinned": ["C", "X"], "hidden": ["B"], "send_only": ["D"]}
    assert upkeep.column_order(list("ABCD"), grid, ("row",)) == ["row", "C", "A"] and upkeep.column_order(list("ABCD"), grid, show_all=True) == ["C", "A", "B"]
