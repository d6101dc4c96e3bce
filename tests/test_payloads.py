"""Payloads in every form against a plain reader, through the engine, and grounding over trees."""

import json

import pytest

from millrace.operators import engine, payloads

MIXED = {
    "header": {"po_number": {"value": " 4711 ", "src": "3", "confidence": "0.95"}, "po_date": "2026-01-05", "brand_text": None, "order_text": True, "extra": {"dept": {"value": 7}, "free": "x", "none": None}},
    "totals": {"line_count": "3", "total_qty": "1,2 12", "total_amount": 5},
    "lines": [
        {"our_item": "i1", "quantity": "5", "src": 3},
        {"our_item": {"value": " i2 ", "src": 9}, "quantity": 6, "src": "412", "src_end": 413.0, "confidence": "0.8", "page": 2, "chunk": [1, "500"], "extra": {"dept": "shoes", "size": {"value": "L", "confidence": 0.1}}},
        {"our_item": {"src": "x", "value": None}, "quantity": {"value": "", "src": None}, "src": True, "confidence": "high", "chunk": [1, 2, 3]},
        "no object",
        {"quantity": {"value": "7", "src": "eight"}, "src": " 8 ", "unit": ["a"], "remark": "ß", "chunk": [None, 2]},
    ],
}
DEEP = {"shipments": [{"src": "2", "src_end": 40.0, "shipment_no": "S1", "remark": {"value": "r", "src": 4}, "lines": [{"quantity": "1", "src": 5}]}, {"lines": []}, "odd"], "lines": [{"quantity": "99"}]}
BAD = ["{", "[1]", '"text"', "null", '{"header": 5}', '{"header": [1], "lines": []}', '{"lines": "abc"}', '{"shipments": {"a": 1}}', '{"totals": "x"}', None]


def plain_int(x):
    if isinstance(x, bool) or x is None:
        return None
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def plain_float(x):
    if isinstance(x, bool) or x is None:
        return None
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def plain_leaf(x, anchor=(None, None, None, None)):
    if x is None:
        return None
    if not isinstance(x, dict):
        return (plain_text(x), *anchor)
    reads = (plain_int, plain_int, plain_int, plain_float)
    return (plain_text(x.get("value")), *(read(x[k]) if x.get(k) is not None else a for k, read, a in zip(payloads.ANCHORS, reads, anchor, strict=True)))


def plain_text(x):
    return None if x is None else json.dumps(x, separators=(",", ":")) if isinstance(x, (list, dict)) else str(x).strip()


def plain_values(tree):
    out = {}

    def walk(prefix, node, keys, anchor, extra, rng=(None, None)):
        node = node if isinstance(node, dict) else {}
        named = [(k, node.get(k)) for k in keys] + [("extra." + k, v) for k, v in (node.get("extra") or {}).items() if extra]
        for k, v in named:
            got = plain_leaf(v, anchor)
            if got and got[0] is not None:
                out[prefix + k] = (*got, *rng)

    def line(prefix, node):
        d = node if isinstance(node, dict) else {}
        c = d.get("chunk")
        rng = (plain_int(c[0]), plain_int(c[1])) if isinstance(c, list) and len(c) == 2 and None not in (plain_int(c[0]), plain_int(c[1])) else (None, None)
        walk(prefix, d, engine.LINE_KEYS, (plain_int(d.get("src")), plain_int(d.get("src_end")), plain_int(d.get("page")), plain_float(d.get("confidence"))), True, rng)

    walk("header.", tree.get("header") or {}, engine.HEADER_KEYS, (None,) * 4, True)
    for i, x in enumerate(tree.get("lines") or [], 1):
        line(f"lines[{i}].", x)
    for i, s in enumerate(tree.get("shipments") or [], 1):
        walk(f"shipments[{i}].", s, engine.SHIPMENT_KEYS, (None,) * 4, False)
        for j, x in enumerate((s.get("lines") or []) if isinstance(s, dict) else [], 1):
            line(f"shipments[{i}].lines[{j}].", x)
    return out


@pytest.fixture(scope="module")
def read(spark):
    rows = [("mixed", json.dumps(MIXED)), ("deep", json.dumps(DEEP)), ("empty", "{}"), ("nulls", '{"header": null, "lines": null, "shipments": null, "totals": null}'), *((f"bad{i}", b) for i, b in enumerate(BAD))]
    return payloads.read_payloads(spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, payload string, problem int").drop("problem").repartition(3))


def test_values(read):
    got = {}
    for r in payloads.payload_values(read).collect():
        got.setdefault(r.doc_id, {})[r.path] = (r.value, r.src, r.src_end, r.page, r.confidence, r.lo, r.hi)
        assert r.leaf == r.path.split(".")[-1]
    assert got == {"mixed": plain_values(MIXED), "deep": plain_values(DEEP)}


def test_problems(read):
    got = {r.doc_id: r.problem for r in read.collect()}
    assert got["mixed"] is None and got["deep"] is None and got["empty"] is None and got["nulls"] is None
    assert [got[f"bad{i}"] for i in range(len(BAD))] == ["the payload is no JSON object"] * 4 + ["header is not an object"] * 2 + ["lines is not a list", "shipments is not a list", "totals is not an object", "the payload is no JSON object"]


def test_rows(read):
    rows = {(r.doc_id, r.ship_idx, r.line_no): r for r in payloads.payload_rows(read).collect()}
    assert set(rows) == {("mixed", 0, i) for i in range(1, 6)} | {("deep", 1, 1)}
    first = rows["mixed", 0, 1]
    assert (first.line.our_item.value, first.line.quantity.value, first.line.quantity.src, first.header.po_number.value, first.totals.line_count) == ("i1", "5", 3, "4711", 3)
    second = rows["mixed", 0, 2].line
    assert tuple(second.our_item) == ("i2", 9, 413, 2, 0.8) and tuple(second.quantity) == ("6", 412, 413, 2, 0.8) and (second.lo, second.hi) == (1, 500)
    assert second.extra["size"].confidence == 0.1 and second.extra["dept"].value == "shoes"
    assert rows["mixed", 0, 4].line.quantity is None and rows["mixed", 0, 5].line.quantity.src is None
    deep = rows["deep", 1, 1]
    assert (deep.shipment.shipment_no.value, deep.shipment.src_end, deep.split, deep.line.quantity.value) == ("S1", 40, True, "1")


def test_build_from_flat_lines_with_declared_fields(read):
    book = {
        "fields": {"ITEM": {"from": "doc", "path": "line.our_item"}, "QTY": {"from": "doc", "path": "line.quantity"}, "DEPT": {"from": "doc", "path": "line.extra.dept"}, "HEAD": {"from": "doc", "path": "header.extra.dept"}, "FREE": {"from": "doc", "path": "header.extra.free"}},
        "field_specs": {k: {} for k in ("ITEM", "QTY", "DEPT", "HEAD", "FREE")},
    }
    want = {"r_0001": ("i1", "5", "", "7", ""), "r_0002": ("i2", "6", "shoes", "7", ""), "r_0003": ("", "", "", "7", ""), "r_0004": ("", "", "", "7", ""), "r_0005": ("", "7", "", "7", "")}
    typed = payloads.payload_rows(read.filter("doc_id = 'mixed'"), ["dept"])
    assert typed.schema["line"].dataType["extra"].dataType.simpleString() == f"struct<dept:{engine.VALUE}>"
    assert {r.row_id: (r.ITEM, r.QTY, r.DEPT, r.HEAD, r.FREE) for r in engine.build_rows(typed, book).collect()} == want
    free = engine.build_rows(payloads.payload_rows(read.filter("doc_id = 'mixed'")), book).collect()
    assert {r.FREE for r in free} == {"x"}


def test_structure(read, spark):
    got = {(r.doc_id, r.path, r.code) for r in payloads.structure_issues(read).collect()}
    assert got == {("mixed", "totals.line_count", "TOTAL_MISMATCH"), ("deep", "shipments[2].lines", "NO_LINES"), ("deep", "shipments[3].lines", "NO_LINES"), ("empty", "lines", "NO_LINES"), ("nulls", "lines", "NO_LINES")}
    sums = [("ok", "18", ["5", "6 pcs", "7"]), ("off", "19", ["5", "6", "7"]), ("unread", "19", ["5", "x"]), ("none", "", ["5"]), ("odd", "1-2", ["5"])]
    rows = [(d, json.dumps({"totals": {"total_qty": t}, "lines": [{"quantity": q} for q in qs]})) for d, t, qs in sums]
    found = payloads.structure_issues(payloads.read_payloads(spark.createDataFrame(rows, "doc_id string, payload string")))
    assert {(r.doc_id, r.path) for r in found.collect()} == {("off", "totals.total_qty")}


def test_grounding_of_trees(spark):
    lines = ["===== PAGE 1 =====", "PO 4711", "item AB-1234 big red ring 5", "item CD-9 6"]
    tree = {
        "header": {"po_number": {"value": "4711", "src": 2, "confidence": 0.6}},
        "lines": [
            {"item_code": "AB-1234", "quantity": "5", "src": 3, "confidence": 0.95}, {"item_code": "CD-9", "quantity": "7", "src": "4"},
            {"item_code": "XX-9999", "src": 4, "chunk": [1, 3]}, {"description": "big red thing", "src": 3.0, "confidence": 0.8},
        ],
    }
    docs = spark.createDataFrame([("text", lines, True, True), ("scan", lines, False, True)], "doc_id string, lines array<string>, has_text boolean, anchored boolean")
    read = payloads.read_payloads(spark.createDataFrame([(d, json.dumps(tree)) for d in ("text", "scan", "lost")], "doc_id string, payload string"))
    got = {tuple(r) for r in payloads.ground_payloads(read, docs).collect()}
    unsure = {("header.po_number", "error", "LOW_CONFIDENCE"), ("lines[4].description", "warn", "LOW_CONFIDENCE")}
    wrong = {("lines[2].quantity", "error", "EVIDENCE_NOT_FOUND"), ("lines[3].item_code", "error", "EVIDENCE_NOT_FOUND"), ("lines[4].description", "warn", "EVIDENCE_WEAK")}
    assert got == {("text", *x) for x in unsure | wrong} | {("scan", *x) for x in unsure}


def test_empty_table(spark):
    none = payloads.read_payloads(spark.createDataFrame([], "doc_id string, payload string"))
    assert payloads.payload_rows(none).count() == payloads.payload_values(none).count() == payloads.structure_issues(none).count() == 0
