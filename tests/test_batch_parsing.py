"""A batch's payloads are parsed once, however often its rows and states use them."""

from millrace.operators import batches


def test_payloads_are_parsed_once(spark):
    files = spark.createDataFrame([("b", "f1", 1, None), ("b", "f2", 2, "gone")], "batch_id string, file_id string, place int, error string")
    sent = spark.createDataFrame([("f1", '{"lines": [{"quantity": "5"}]}')], "file_id string, payload string")
    docs = spark.createDataFrame([("f1", ["5"], True, True)], "file_id string, lines array<string>, has_text boolean, anchored boolean")
    book = {"fields": {"QTY": {"from": "doc", "path": "line.quantity"}}, "field_specs": {}}
    for df in batches.parse_batch(files, sent, docs, book):
        node = df._jdf.queryExecution().withCachedData()
        assert "InMemoryRelation" in node.toString()
        leaves = node.collectLeaves()
        kinds = [leaves.apply(i).nodeName() for i in range(leaves.size())]
        assert kinds.count("InMemoryRelation") >= 2
