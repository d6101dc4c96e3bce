"""No link is lost in buckets of more items than a small one has, where no hub is linked with either item."""

from millrace.llm import linking, near_dedup


def pairs_only(spark, n):
    """What links items 2 i and 2 i + 1 alone."""
    truth = spark.range(n // 2).selectExpr("2 * id AS a", "2 * id + 1 AS b")
    return lambda pairs: pairs.join(truth, ["a", "b"], "left_semi").select("a", "b")


def together(groups):
    return {r["node"]: r["component"] for r in groups.collect()}


def test_grouped(spark):
    """200 items of one bucket that only go in pairs."""
    n = 200
    items = spark.range(n).selectExpr("id AS item", "array(1L) AS keys")
    shared = linking.crowded(items, items["keys"])
    got = together(linking.grouped(items, shared, [], pairs_only(spark, n), last=lambda some: some.selectExpr("item", "7L AS bucket")))
    assert all(got.get(i) == i - i % 2 for i in range(n))


def test_grouped_by_rarity(spark):
    n = 200
    items = spark.range(n).selectExpr("id AS item", "array(1L) AS keys", "10 AS words")
    shared = linking.crowded(items, items["keys"], ("words",))
    got = together(linking.grouped_by_rarity(shared, "words", lambda x, y: x == y, lambda some: (pairs_only(spark, n), lambda open_items: open_items.selectExpr("item", "7L AS bucket"))))
    assert all(got.get(i) == i - i % 2 for i in range(n))


def test_pairs_that_may_link(spark):
    """What rules pairs of sets out lets each pair at the threshold through at its rarest common shingle."""
    rows = spark.createDataFrame([(100, 100, 89, 89, True), (100, 100, 88, 100, False), (80, 100, 80, 80, True), (79, 100, 79, 79, False)], "n1 long, n2 long, rest1 long, rest2 long, want boolean")
    rows = rows.selectExpr("struct(n1 AS n, rest1 AS rest) AS x", "struct(n2 AS n, rest2 AS rest) AS y", "want")
    assert all(got == want for got, want in rows.select(near_dedup.may_link(80)(rows["x"], rows["y"]), "want").collect())


def test_every_pair_of_a_large_bucket_once(spark, monkeypatch):
    """Tiles give each pair of different groups once, whatever their number."""
    monkeypatch.setattr(linking, "TILE", 7)
    rows = spark.createDataFrame([(b, i, i % 3, n) for b, n in ((1, 60), (2, 5), (3, 1)) for i in range(100 * b, 100 * b + n)], "bucket long, item long, label long, held long")
    got = [tuple(r) for r in linking.every_pair(rows, lambda x, y: x["item"] + y["item"] > 0).collect()]
    want = {(a, b) for lo, n in ((100, 60), (200, 5)) for a in range(lo, lo + n) for b in range(a + 1, lo + n) if a % 3 != b % 3}
    assert len(got) == len(want) and set(got) == want
