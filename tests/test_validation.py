"""Each check of rule books with a book that fails and one that passes, and rule books as tables."""

import copy

import pytest

from millrace.operators import validation

GOOD = {
    "meta": {"code": "A", "name": "Acme", "customer_no": 7, "owner": "someone", "file_types": ["pdf", "htm"]},
    "field_specs": {"PO": {}, "SHIP": {}, "ITEM": {}, "NOTE": {}, "BRAND": {}},
    "extraction": {"extra_fields": [{"name": "dept"}], "chunking": {"enabled": True, "max_lines_per_chunk": 100, "safety_ratio": 0.8}, "hints": 'See "PO NUMBER"'},
    "fields": {
        "PO": {"from": "doc", "path": "header.po_number", "fallback": "header.extra.dept", "format": "upper", "required": True}, "SHIP": {"from": "table"}, "ITEM": {"from": "rule", "rule": "items"},
        "NOTE": {"from": "expr", "expr": "concat(line.remark, field.PO, _kind, items)"}, "BRAND": {"from": "rule", "rule": "brand", "choices": "brand"},
    },
    "tables": {"routes": {"when": [{"source": "header.order_text", "op": "equals"}, {"source": "line.line_no", "op": "regex"}], "then": ["SHIP", "_kind"], "rows": [{"when": ["a", "*"], "then": ["1", "x"]}, {"when": ["*", "*"], "then": ["2", "y"]}], "on_no_match": {"action": "warn"}}},
    "rules": {"items": {"kind": "keyword_map", "source": "line.description", "entries": [{"contains": "a", "value": "b"}], "on_no_match": {"action": "warn"}}, "brand": {"kind": "csv_choice", "filter_column": "kunnr", "value_column": "zbrand", "on_no_match": {"action": "warn"}, "on_many": {"action": "warn"}}},
}
BREAKS = [
    (1, "error", lambda b: b["fields"].pop("PO")), (1, "error", lambda b: b["fields"].update(X={"from": "const"})), (2, "error", lambda b: b["fields"]["PO"].update({"from": "guess"})), (2, "error", lambda b: b["rules"]["items"].update(kind="magic")),
    (2, "error", lambda b: b["tables"]["routes"]["when"][0].update(op="like")), (2, "error", lambda b: b["tables"]["routes"]["rows"][0]["when"].pop()), (2, "error", lambda b: b["fields"]["PO"].update(format="roman")),
    (3, "error", lambda b: b["fields"]["ITEM"].update(rule="none")), (3, "error", lambda b: b["fields"]["PO"].update({"from": "table"})), (4, "error", lambda b: b["fields"]["NOTE"].update(expr="shell('x')")),
    (5, "error", lambda b: b["fields"]["PO"].update(path="header.secret")), (5, "error", lambda b: b["fields"]["NOTE"].update(expr="line.extra.size")), (5, "error", lambda b: b["rules"]["items"].update(source="shipment.extra.dept")),
    (6, "warn", lambda b: b["tables"]["routes"]["rows"].append({"when": ["z", "*"], "then": ["3", "z"]})), (6, "warn", lambda b: b["tables"]["routes"]["rows"].insert(1, {"when": ["a", "*"], "then": ["3", "z"]})),
    (7, "warn", lambda b: b["tables"]["routes"].pop("on_no_match")), (7, "warn", lambda b: b["rules"]["brand"].pop("on_no_match")), (8, "report", lambda b: b["fields"]["PO"].update(todo="ask")), (8, "report", lambda b: b["rules"]["items"]["entries"][0].update(todo="ask")),
    (9, "warn", lambda b: b["meta"].update(owner=" ")), (12, "error", lambda b: b["extraction"]["chunking"].update(max_lines=5)), (12, "error", lambda b: b["extraction"]["chunking"].update(safety_ratio=0)),
    (13, "error", lambda b: b["rules"]["brand"].update(on_many={"action": "default"})), (14, "error", lambda b: b["fields"]["BRAND"].update(choices="items")),
]


def test_a_good_book_has_no_findings():
    assert validation.book_report(GOOD) == []


@pytest.mark.parametrize("number", range(len(BREAKS)))
def test_checks(number):
    check, level, spoil = BREAKS[number]
    book = copy.deepcopy(GOOD)
    spoil(book)
    assert (check, level) in {f[:2] for f in validation.book_report(book)}


def test_chunk_policy():
    base = {k: 1 for k in validation.CHUNKING}
    assert validation.chunk_policy(base, {"tokens_per_line": 9, "other": 1}) == {**base, "tokens_per_line": 9}
    with pytest.raises(ValueError, match="enabled"):
        validation.chunk_policy({}, {"tokens_per_line": 9})


def test_views(spark):
    views = validation.book_views(spark, {"A": GOOD})
    assert {v: df.count() for v, df in views.items()} == {"customers": 1, "fixed": 0, "document": 1, "decision": 2, "expressions": 1, "hints": 1, "guide": 7}
    assert tuple(views["customers"].first()) == ("A", "Acme", "7", "pdf / htm", "someone", "draft", "none", "")
    assert views["decision"].first().conditions == "a / *" and views["decision"].first().on_no_match == "warn"


def test_reference_checks(spark):
    books = spark.createDataFrame([("a", "1", "Acme"), ("b", "2", "Bolt"), ("c", "3", "Cog")], "book string, customer_no string, name string")
    brands = spark.createDataFrame([("1", "X", "", 0), ("1", "Y", "Acme", 1), ("2", "X", "Bolts", 2)], "kunnr string, zbrand string, name1 string, _ord int")
    manual = spark.createDataFrame([("1", "Y", "suppress", "n", 0), ("2", "Z", "add", "n", 1), ("2", "Q", "override", "", 2), ("2", "X", None, "n", 3)], "kunnr string, zbrand string, action string, note string, _ord int")
    outputs = spark.createDataFrame([("a", "1", "X"), ("a", "1", "Y"), ("b", "2", "Z"), ("b", "2", None), ("c", "3", "X")], "book string, customer_no string, value string")
    got = sorted((r.check, r.place) for r in validation.reference_report(books, brands, manual, outputs).collect())
    assert got == [(10, "book a"), (10, "book c"), (11, "book c"), (15, "book b"), (16, "book b"), (17, "2/Q"), (17, "2/X"), (18, "2/Q"), (19, "1/Y"), (19, "2/Q"), (19, "2/X"), (19, "2/Z")]
    none = [df.limit(0) for df in (books, brands, manual, outputs)]
    assert validation.reference_report(*none).count() == 0
