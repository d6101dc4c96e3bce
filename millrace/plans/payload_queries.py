"""Queries of payloads as extraction returns them: rows, declared extra fields, grounding and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches, payloads
from .common import TIE_SQL, query, table
from .rule_queries import order_lines

# Each order is a document: a page header, a head line with the order's key, and two lines an item, in the order of suppliers. An item's value may be
# a scalar or a struct, its line numbers numbers or texts, by the form (order + place in the order) % 6.
_FORM, _AT = "(doc_id + n) % 6", "(1 + 2 * n)"
_ITEMS = {
    0: '\'{"item_code": "P-\' || code || \'", "quantity": \' || qty || \', "src": \' || at || \', "confidence": 0.95}\'',
    1: '\'{"item_code": " P-\' || code || \' ", "quantity": "\' || qty || \'", "src": "\' || at || \'", "src_end": \' || at || \'.0, "confidence": "0.8"}\'',
    2: '\'{"item_code": {"value": "P-\' || code || \'", "src": \' || at || \', "confidence": 0.6}, "quantity": {"value": \' || qty || \'}, "description": "alpha beta gamma", "src": "\' || at || \'"}\'',
    3: '\'{"item_code": "P-\' || code || \'", "quantity": "\' || qty || \'", "src": 2, "extra": {"color": "c\' || qty || \'", "size": {"value": \' || qty || \', "src": "\' || at || \'"}}}\'',
    4: '\'{"item_code": "X-\' || code || \'.0", "quantity": {"value": "\' || qty || \'", "src": true}, "src": \' || at || \', "page": true, "confidence": null, "chunk": [1, "\' || (at + 1) || \'"]}\'',
    5: '\'{"item_code": "P-\' || code || \'", "quantity": "\' || qty || \'", "src": \' || at || \', "chunk": [\' || (at + 1) || \', 9999]}\'',
}
_ITEM_TEXT = "CASE " + " ".join(f"WHEN doc_id % 97 = 5 AND {_FORM} = 0 THEN '\"no object\"' WHEN {_FORM} = {k} THEN {v}" for k, v in _ITEMS.items()) + " END"


def wire_items(spark, sf_dir) -> DataFrame:
    """doc_id, ship_idx, line_no, n (place in the order), code, qty, at (its line in the document), item (JSON)."""
    from pyspark.sql import Window

    lines = order_lines(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ship_idx", "line_no")))
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), "ship_idx", "line_no", "n", F.format_string("%06d", F.col("l_partkey")).alias("code"), F.col("l_quantity").cast("int").alias("qty"), F.expr(_AT).alias("at"))
    return rows.withColumn("item", F.expr(_ITEM_TEXT.replace('\\', '\\\\')))


def wire_payloads(spark, sf_dir) -> DataFrame:
    """doc_id, payload: orders by key % 4 with their lines above (0), with shipments (1, 2; the last one of 2 is empty), or broken off (3)."""
    units = wire_items(spark, sf_dir).groupBy("doc_id", "ship_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item"))), lambda x: x["item"]), ", ").alias("items"), F.count("*").alias("count"), F.sum("qty").alias("qty"))
    docs = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ship_idx", "items"))).alias("units"), F.sum("count").alias("count"), F.sum("qty").alias("qty"))
    head = F.when(F.col("doc_id") % 2 == 0, F.format_string('"%d"', "doc_id")).otherwise(F.format_string('{"value": %d, "src": "2"}', "doc_id"))
    shipment = lambda u: F.format_string('{"shipment_no": {"value": "S%d", "src": 2.0}, "lines": [%s]}', u["ship_idx"], u["items"])
    flat = F.concat(F.lit('"lines": ['), F.array_join(F.transform("units", lambda u: u["items"]), ", "), F.lit("]"))
    more = F.when(F.col("doc_id") % 4 == 2, ', {"lines": null}').otherwise("")
    deep = F.concat(F.lit('"lines": [{"quantity": "1"}], "shipments": ['), F.array_join(F.transform("units", shipment), ", "), more, F.lit("]"))
    totals = F.format_string('"totals": {"line_count": "%d", "total_qty": "%d pcs"}', F.col("count") + (F.col("doc_id") % 5 == 0).cast("int"), F.col("qty") + (F.col("doc_id") % 7 == 0).cast("int"))
    body = F.concat_ws(", ", F.format_string('{"header": {"po_number": %s}', head), F.when(F.col("doc_id") % 4 == 0, flat).otherwise(deep), totals)
    return docs.select("doc_id", F.when(F.col("doc_id") % 4 == 3, body).otherwise(F.concat(body, F.lit("}"))).alias("payload"))


def wire_documents(spark, sf_dir) -> DataFrame:
    """The text of those orders as lines; orders with a key % 10 of 4 are scans, of 6 were read without line numbers."""
    rows = wire_items(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", F.array(F.format_string("item P-%s alpha beta qty %d", "code", "qty"), F.lit("---")).alias("two")))).alias("rows"))
    lines = F.concat(F.array(F.lit("===== PAGE 1 ====="), F.format_string("order %d of shipments " + " ".join(f"S{i}" for i in range(1, 21)), "doc_id")), F.flatten(F.transform("rows", lambda r: r["two"])))
    return rows.select("doc_id", lines.alias("lines"), (F.col("doc_id") % 10 != 4).alias("has_text"), (F.col("doc_id") % 10 != 6).alias("anchored"))


_WIRE_SQL = f"""w AS (SELECT l_orderkey AS doc_id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS s, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {TIE_SQL}) AS k,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, {TIE_SQL}) AS n, printf('%06d', l_partkey) AS code, CAST(l_quantity AS INTEGER) AS qty FROM lineitem),
x AS (SELECT *, CAST((doc_id + n) % 6 AS INTEGER) AS form, CAST(1 + 2 * n AS INTEGER) AS a, doc_id % 97 = 5 AND (doc_id + n) % 6 = 0 AS odd FROM w WHERE doc_id % 4 <> 3)"""


@query(f"""WITH {_WIRE_SQL} SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE s END AS INTEGER) AS ship_idx, CAST(CASE WHEN doc_id % 4 = 0 THEN n ELSE k END AS INTEGER) AS line_no,
CAST(doc_id AS VARCHAR) AS po_number, CASE WHEN doc_id % 2 = 1 THEN 2 END AS po_src, CASE WHEN doc_id % 4 <> 0 THEN 'S' || s END AS shipment_no,
CASE WHEN odd THEN NULL WHEN form = 4 THEN 'X-' || code || '.0' ELSE 'P-' || code END AS item, CASE WHEN odd THEN NULL WHEN form = 3 THEN 2 ELSE a END AS item_src,
CASE WHEN odd THEN NULL ELSE CAST(qty AS VARCHAR) END AS qty, CASE WHEN odd OR form = 4 THEN NULL WHEN form = 3 THEN 2 ELSE a END AS qty_src, CASE WHEN form = 1 THEN a END AS src_end,
CASE WHEN odd THEN NULL WHEN form = 0 THEN 0.95 WHEN form = 1 THEN 0.8 WHEN form = 2 THEN 0.6 END AS confidence, CASE WHEN form = 4 THEN 1 WHEN form = 5 THEN a + 1 END AS lo, CASE WHEN form = 4 THEN a + 1 WHEN form = 5 THEN 9999 END AS hi FROM x""")
def q_payload_wire(spark, sf_dir):
    """Payloads whose values are scalars and structs in one line: values, the anchors that they inherit, chunk ranges, and line numbers as texts."""
    items = payloads.payload_rows(payloads.read_payloads(wire_payloads(spark, sf_dir)))
    return items.select(
        "doc_id", "ship_idx", "line_no", F.col("header.po_number.value").alias("po_number"), F.col("header.po_number.src").alias("po_src"), F.col("shipment.shipment_no.value").alias("shipment_no"), F.col("line.item_code.value").alias("item"),
        F.col("line.item_code.src").alias("item_src"), F.col("line.quantity.value").alias("qty"), F.col("line.quantity.src").alias("qty_src"), "line.src_end", F.col("line.item_code.confidence").alias("confidence"), "line.lo", "line.hi",
    )


@query(f"""WITH {_WIRE_SQL} SELECT doc_id, n, 'c' || qty AS color, 2 AS color_src, CAST(qty AS VARCHAR) AS size, a AS size_src FROM x WHERE form = 3 AND doc_id % 4 = 0""")
def q_declared_fields(spark, sf_dir):
    """Extra fields that a rule book declares arrive as typed columns with their anchors."""
    items = payloads.payload_rows(payloads.read_payloads(wire_payloads(spark, sf_dir)), ["color", "size", "weight"])
    found = items.filter("NOT split AND line.extra.color.value IS NOT NULL AND line.extra.weight.value IS NULL")
    return found.select("doc_id", F.col("line_no").cast("long").alias("n"), *(F.col(f"line.extra.{c}").alias(a) for c, a in (("color.value", "color"), ("color.src", "color_src"), ("size.value", "size"), ("size.src", "size_src"))))


# Form 3 points at the head line; 4 names a part that the document hasn't, and a quantity without a line; 5 lies outside its chunk.
_FOUND_SQL = """p AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'lines[' || n || '].' ELSE 'shipments[' || s || '].lines[' || k || '].' END AS prefix, doc_id % 10 NOT IN (4, 6) AS judged FROM x WHERE NOT odd),
found AS (SELECT doc_id, prefix || 'item_code' AS path, 'error' AS level, 'EVIDENCE_NOT_FOUND' AS code FROM p WHERE judged AND form IN (3, 4, 5)
UNION ALL SELECT doc_id, prefix || 'quantity', 'error', 'EVIDENCE_NOT_FOUND' FROM p WHERE judged AND form IN (4, 5)
UNION ALL SELECT doc_id, prefix || 'quantity', 'error', 'EVIDENCE_NOT_FOUND' FROM p WHERE judged AND form = 3 AND qty > 20
UNION ALL SELECT doc_id, prefix || 'extra.color', 'error', 'EVIDENCE_NOT_FOUND' FROM p WHERE judged AND form = 3
UNION ALL SELECT doc_id, prefix || 'description', 'warn', 'EVIDENCE_WEAK' FROM p WHERE judged AND form = 2
UNION ALL SELECT doc_id, prefix || 'item_code', CASE WHEN form = 2 THEN 'error' ELSE 'warn' END, 'LOW_CONFIDENCE' FROM p WHERE form IN (1, 2)
UNION ALL SELECT doc_id, prefix || 'quantity', 'warn', 'LOW_CONFIDENCE' FROM p WHERE form = 1
UNION ALL SELECT DISTINCT doc_id, 'header.po_number', 'error', 'EVIDENCE_NOT_FOUND' FROM x WHERE doc_id % 2 = 0 AND doc_id % 10 NOT IN (4, 6)
UNION ALL SELECT DISTINCT doc_id, 'lines[1].quantity', 'error', 'EVIDENCE_NOT_FOUND' FROM x WHERE doc_id % 4 <> 0 AND doc_id % 10 NOT IN (4, 6))"""
_STRUCTURE_SQL = """d AS (SELECT doc_id, max(s) AS ships, sum(CASE WHEN odd THEN 0 ELSE qty END) AS qty, sum(qty) AS printed, bool_or(odd) AS odd FROM x GROUP BY 1),
bad AS (SELECT doc_id, 'totals.line_count' AS path, 'error' AS level, 'TOTAL_MISMATCH' AS code FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'totals.total_qty', 'error', 'TOTAL_MISMATCH' FROM d WHERE doc_id % 7 = 0 AND NOT odd
UNION ALL SELECT doc_id, 'shipments[' || (ships + 1) || '].lines', 'error', 'NO_LINES' FROM d WHERE doc_id % 4 = 2)"""


@query(f"WITH {_WIRE_SQL}, {_FOUND_SQL} SELECT * FROM found")
def q_ground_payloads(spark, sf_dir):
    """Grounding of every value of every tree against its document: anchors, chunk ranges, part numbers, confidence; scans judged by confidence alone."""
    from ..operators.grounding import ground

    values = payloads.to_ground(payloads.payload_values(payloads.read_payloads(wire_payloads(spark, sf_dir))))
    return ground(values, wire_documents(spark, sf_dir))


@query(f"WITH {_WIRE_SQL}, {_STRUCTURE_SQL} SELECT * FROM bad")
def q_payload_structure(spark, sf_dir):
    """Shipments and documents without lines, and totals that don't agree."""
    return payloads.structure_issues(payloads.read_payloads(wire_payloads(spark, sf_dir)))


def order_batches(spark, sf_dir):
    """A batch for each customer: its orders are files. Keys % 17 of 3 can't be read, those % 13 of 5 have no lines, some payloads are broken off."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    files = orders.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").cast("string").alias("place"), F.when(F.col("o_orderkey") % 17 == 3, "no such file").alias("error"))
    bare = F.format_string('{"header": {"po_number": "%d", "po_date": "2026-01-05"}, "shipments": [{"lines": []}], "totals": {"line_count": 3}}', "doc_id")
    sent = wire_payloads(spark, sf_dir).withColumn("payload", F.when(F.col("doc_id") % 13 == 5, bare).otherwise(F.col("payload")))
    return files, sent.withColumnRenamed("doc_id", "file_id"), wire_documents(spark, sf_dir).withColumnRenamed("doc_id", "file_id")


BATCH_BOOK = {
    "fields": {"PO": {"from": "doc", "path": "header.po_number"}, "ITEM": {"from": "doc", "path": "line.item_code"}, "QTY": {"from": "doc", "path": "line.quantity", "format": "integer"}},
    "field_specs": {"PO": {"required": True}, "ITEM": {"required": True}, "QTY": {"required": True}},
}
# In the SQL twins a file without lines has errors in the header (where it is judged), its printed line count, and its missing lines.
_FILES_SQL = f"""{_WIRE_SQL}, {_FOUND_SQL}, {_STRUCTURE_SQL},
f AS (SELECT o_custkey AS batch_id, o_orderkey AS file_id, CAST(o_orderdate AS VARCHAR) AS place, o_orderkey % 17 = 3 AS unread, o_orderkey % 13 = 5 AS bare, o_orderkey % 4 = 3 AS broken, o_orderkey % 10 NOT IN (4, 6) AS judged
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT f.*, CASE WHEN unread OR bare OR broken THEN 0 ELSE (SELECT count(*) FROM x WHERE doc_id = file_id) END AS row_count FROM f),
g AS (SELECT *, row_count = 0 AND NOT unread AND bare AS empty, coalesce(sum(row_count) OVER (PARTITION BY batch_id ORDER BY place, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)"""


@query(f"""WITH {_FILES_SQL} SELECT batch_id, file_id, CASE WHEN unread OR broken OR bare THEN 'FAILED' ELSE 'DONE' END AS status,
CASE WHEN unread THEN 'no such file' WHEN empty AND judged THEN 'header.po_date: EVIDENCE_NOT_FOUND / header.po_number: EVIDENCE_NOT_FOUND / totals.line_count: TOTAL_MISMATCH (and 2 more)'
WHEN empty THEN 'totals.line_count: TOTAL_MISMATCH / lines: NO_LINES / shipments[1].lines: NO_LINES' WHEN broken THEN 'the payload is no JSON object' ELSE '' END AS error, row_count,
CASE WHEN unread THEN '' WHEN empty THEN '3' WHEN broken THEN '' ELSE CAST(row_count + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS doc_line_count,
CASE WHEN unread OR empty OR broken THEN '' ELSE (SELECT sum(qty) FROM x WHERE doc_id = file_id) + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END || ' pcs' END AS doc_total_qty,
CASE WHEN unread THEN false WHEN empty THEN true WHEN broken THEN false ELSE file_id % 4 <> 0 END AS doc_split FROM g""")
def q_batch_files(spark, sf_dir):
    """The state of every file of every batch: done, or failed with up to three reasons."""
    _, states = batches.parse_batch(*order_batches(spark, sf_dir), BATCH_BOOK)
    return states.drop("doc_total_amount")


@query(f"""WITH {_FILES_SQL}, r AS (SELECT g.batch_id, g.file_id, g.before, x.*, row_number() OVER (PARTITION BY g.file_id ORDER BY s, k) AS place_in_file,
CASE WHEN file_id % 4 = 0 THEN 'lines[' || n || '].' ELSE 'shipments[' || s || '].lines[' || k || '].' END AS prefix FROM g JOIN x ON doc_id = file_id WHERE row_count > 0),
e AS (SELECT *, regexp_extract(path, '^(shipments\\[\\d+\\]\\.)?lines\\[\\d+\\]\\.') AS own FROM (SELECT * FROM found UNION ALL SELECT * FROM bad)),
l AS (SELECT e.*, EXISTS (SELECT 1 FROM r WHERE r.file_id = e.doc_id AND r.prefix = e.own) AS lands FROM e),
h AS (SELECT r.file_id, r.prefix, l.level FROM r JOIN l ON l.doc_id = r.file_id AND (l.lands AND l.own = r.prefix OR NOT l.lands)),
t AS (SELECT file_id, prefix, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS errors FROM h GROUP BY ALL)
SELECT r.batch_id, r.file_id, printf('r_%04d', CAST(before + place_in_file AS BIGINT)) AS row_id, CASE WHEN odd THEN '' WHEN form = 4 THEN 'X-' || code || '.0' ELSE 'P-' || code END AS item,
CASE WHEN odd THEN '' ELSE CAST(qty AS VARCHAR) END AS qty, coalesce(t.n, 0) + CASE WHEN odd THEN 2 ELSE 0 END AS n_issues, coalesce(t.errors, 0) + CASE WHEN odd THEN 2 ELSE 0 END AS n_errors
FROM r LEFT JOIN t ON t.file_id = r.file_id AND t.prefix = r.prefix""")
def q_batch_rows(spark, sf_dir):
    """Rows of every batch, numbered through its files, with the engine's issues and grounding's."""
    found, _ = batches.parse_batch(*order_batches(spark, sf_dir), BATCH_BOOK)
    errors = F.size(F.filter("issues", lambda x: x["severity"] == "error"))
    return found.select("batch_id", "file_id", "row_id", F.col("ITEM").alias("item"), F.col("QTY").alias("qty"), F.size("issues").cast("long").alias("n_issues"), errors.cast("long").alias("n_errors"))
