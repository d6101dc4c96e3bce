"""Payloads are read in one pass, dealt over the cluster by document, and only as far as a rule book asks."""

import json

from pyspark.sql import functions as F

from millrace.operators import batches, payloads

TREE = {
    "header": {"po_number": {"value": "4711", "src": 2}},
    "shipments": [{"shipment_no": "S1", "lines": [{"item_code": "a", "quantity": {"value": 5, "src": 9}, "remark": "r", "src": 3, "extra": {"dept": "x"}}, "odd"]}],
    "lines": [{"quantity": "7"}],
}
BOOK = {"fields": {"QTY": {"from": "doc", "path": "line.quantity"}, "PO": {"from": "doc", "path": "header.po_number"}}, "field_specs": {"QTY": {}, "PO": {}}}


def test_lists_are_read_without_building_each_part_first(spark):
    read = payloads.read_payloads(spark.createDataFrame([("d", json.dumps(TREE))], "doc_id string, payload string"))
    for df in (payloads.payload_values(read), payloads.payload_rows(read), payloads.structure_issues(read)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "$.lines, ArrayType(" in plan and "$.shipments, ArrayType(" in plan
        assert "$.lines, ArrayType(VariantType" not in plan and "$.shipments, ArrayType(VariantType" not in plan


def test_only_what_is_wanted_is_worked_out(spark):
    read = payloads.read_payloads(spark.createDataFrame([("d", json.dumps(TREE))], "doc_id string, payload string"))
    first, odd = payloads.payload_rows(read, wanted={"quantity", "shipment_no"}, anchored=False).orderBy("line_no").collect()
    assert tuple(first.line.quantity) == ("5", None, None, None, None) and first.line.src == 3 and first.shipment.shipment_no.value == "S1"
    assert first.line.item_code is None and first.line.extra is None and first.header.po_number is None and odd.line.quantity is None
    whole = payloads.payload_rows(read)
    assert whole.schema == payloads.payload_rows(read, wanted=(), anchored=False).schema
    full = whole.orderBy("line_no").first()
    assert tuple(full.line.quantity)[:2] == ("5", 9) and full.line.extra["dept"].src == 3 and full.line.remark.value == "r"


def test_keys_of_rule_books():
    book = {"rules": {"r": {"kind": "lookup", "source": ["line.unit"], "on_no_match": {"message": "none for {remark}"}}}, "tables": [{"columns": [{"source": "header.extra.dept"}]}]}
    assert {"unit", "remark", "extra", "receiving_loc", "shipment_no"} == batches.keys_used(book)


def test_payloads_are_dealt_by_document(spark):
    ids = spark.range(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_id"))
    files = ids.select(F.lit("b").alias("batch_id"), "file_id", F.lit(1).alias("place"), F.lit(None).cast("string").alias("error"))
    docs = ids.select("file_id", F.array(F.lit("4711")).alias("lines"), F.lit(True).alias("has_text"), F.lit(True).alias("anchored"))
    rows, states = batches.parse_batch(files, ids.withColumn("payload", F.lit(json.dumps(TREE))), docs, BOOK)
    assert [tuple(r) for r in rows.select("file_id", "row_id", "QTY", "PO").orderBy("row_id").limit(2).collect()] == [("f0", "r_0001", "5", "4711"), ("f0", "r_0002", "", "4711")]
    assert {(r.status, r.row_count, r.doc_split) for r in states.collect()} == {("DONE", 2, True)}
    leaves = rows._jdf.queryExecution().withCachedData().collectLeaves()
    plans = [leaves.apply(i).cacheBuilder().cachedPlan().toString() for i in range(leaves.size()) if leaves.apply(i).nodeName() == "InMemoryRelation"]
    parsed = [p for p in plans if "parseJson" in p]
    assert parsed and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in parsed)
