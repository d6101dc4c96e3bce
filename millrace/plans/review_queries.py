"""Queries of reference tables, review and sending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pad_left
from ..operators import engine, references, review
from .common import TIE, TIE_SQL, decimal, query, rows, table


@query("""WITH lines AS (SELECT l_orderkey AS doc_id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS s, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY """ + TIE_SQL + """) AS n,
printf('r_%04d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, """ + TIE_SQL + """)) AS row_id FROM lineitem),
i AS (SELECT event_id % 500 AS doc_id, CASE event_type WHEN 'click' THEN 'line' WHEN 'view' THEN 'line' WHEN 'error' THEN 'order' ELSE 'document' END AS scope, user_id % 4 + 1 AS s, event_id % 3 + 1 AS n, event_type AS code FROM events),
a AS (SELECT DISTINCT doc_id, scope, s, n, code FROM i),
h AS (SELECT a.doc_id, l.row_id, 'KWMENG' AS field, code FROM a JOIN lines l ON a.scope = 'line' AND a.doc_id = l.doc_id AND a.s = l.s AND a.n = l.n
UNION ALL SELECT a.doc_id, l.row_id, '', code FROM a JOIN lines l ON a.scope = 'order' AND a.doc_id = l.doc_id AND a.s = l.s
UNION ALL SELECT a.doc_id, l.row_id, '', code FROM a JOIN lines l ON a.doc_id = l.doc_id WHERE a.scope = 'document'
 OR a.scope = 'line' AND NOT EXISTS (SELECT 1 FROM lines k WHERE k.doc_id = a.doc_id AND k.s = a.s AND k.n = a.n) OR a.scope = 'order' AND NOT EXISTS (SELECT 1 FROM lines k WHERE k.doc_id = a.doc_id AND k.s = a.s))
SELECT doc_id, row_id, field, code, count(*) AS times FROM h GROUP BY ALL""")
def q_issue_distribution(spark, sf_dir):
    """Issues of lines, orders and documents on the rows that they concern."""
    from .rule_queries import order_lines

    lines = order_lines(spark, sf_dir)
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("ship_idx", "line_no")
    lines = lines.select(F.col("l_orderkey").alias("doc_id"), "ship_idx", "line_no", F.format_string("r_%04d", F.row_number().over(order)).alias("row_id"))
    kind = F.when(F.col("event_type").isin("click", "view"), "line").when(F.col("event_type") == "error", "order").otherwise("document")
    issues = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("doc_id"), kind.alias("scope"), (F.col("user_id") % 4 + 1).alias("ship_idx"), (F.col("event_id") % 3 + 1).alias("line_idx"), F.lit("KWMENG").alias("leaf"), F.lit("error").alias("severity"), F.col("event_type").alias("code")).distinct()
    return review.distribute_issues(lines, issues).groupBy("doc_id", "row_id", "field", "code").agg(F.count("*").alias("times"))


MANUAL = [
    ("Brand#2", "small ring", "P", "suppress", "x", 1), ("Brand#3", "red widget", "NEW", "override", "x", 2), ("Brand#3", "red widget", "", "override", "x", 3),
    ("Brand#4", "added", "A1", "add", "x", 4), ("Brand#99", "fresh", "A2", "add", "x", 5), ("", "nobody", "A3", "add", "x", 6), ("Brand#5", "nothing", "Z", "suppress", "", 7),
]
_MANUAL_SQL = "(VALUES " + ", ".join(repr(m) for m in MANUAL) + ") AS m(kunnr, zbrand, name1, action, note, ord)"
_MASTER_SQL = "(SELECT p_brand AS kunnr, p_name AS zbrand, min(p_type) AS name1, CAST(min(p_partkey) AS INTEGER) AS ord FROM part GROUP BY 1, 2)"


def _master(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kunnr"), F.col("p_name").alias("zbrand")).agg(F.min("p_type").alias("name1"), F.min("p_partkey").cast("int").alias("_ord"))
    return p, rows(spark, "kunnr string, zbrand string, name1 string, action string, note string, _ord int", *MANUAL)


@query(f"""WITH m AS (SELECT * FROM {_MANUAL_SQL} WHERE kunnr <> ''), o AS (SELECT kunnr, zbrand, arg_max(name1, ord) AS v FROM m WHERE action = 'override' GROUP BY 1, 2),
k AS (SELECT b.*, o.v, o.kunnr IS NOT NULL AS hit FROM {_MASTER_SQL} b LEFT JOIN o USING (kunnr, zbrand) WHERE NOT EXISTS (SELECT 1 FROM m WHERE action = 'suppress' AND m.kunnr = b.kunnr AND m.zbrand = b.zbrand)),
u AS (SELECT kunnr, zbrand, CASE WHEN coalesce(v, '') <> '' THEN v ELSE name1 END AS name1, CASE WHEN hit THEN 'manual' ELSE 'sap' END AS source, 0 AS a, ord AS b, 0 AS c, 0 AS d FROM k
UNION ALL SELECT kunnr, zbrand, name1, 'manual', CASE WHEN e IS NULL THEN 1 ELSE 0 END, coalesce(e, min(ord) OVER (PARTITION BY kunnr)), 1, ord FROM (SELECT *, (SELECT max(ord) FROM k WHERE k.kunnr = m.kunnr) AS e FROM m WHERE action = 'add'))
SELECT kunnr, zbrand, name1, source, row_number() OVER (PARTITION BY kunnr ORDER BY a, b, c, d) AS place FROM u""")
def q_overlay(spark, sf_dir):
    """A master table under manual suppress, override and add rows, in order."""
    from pyspark.sql import Window

    out = references.overlay(*_master(spark, sf_dir))
    return out.select("kunnr", "zbrand", "name1", F.col("_source").alias("source"), F.row_number().over(Window.partitionBy("kunnr").orderBy("_ord")).cast("long").alias("place"))


@query(f"""WITH b AS {_MASTER_SQL}, m AS (SELECT * FROM {_MANUAL_SQL})
SELECT m.kunnr, m.zbrand, action, 'no_target' AS problem FROM m LEFT JOIN b USING (kunnr, zbrand) WHERE action IN ('override', 'suppress') AND b.ord IS NULL
UNION ALL SELECT m.kunnr, m.zbrand, action, 'exists' FROM m JOIN b USING (kunnr, zbrand) WHERE action = 'add'
UNION ALL SELECT kunnr, zbrand, action, 'repeated' FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1 UNION ALL SELECT kunnr, zbrand, action, 'no_note' FROM m WHERE trim(note) = ''""")
def q_manual_problems(spark, sf_dir):
    """What is wrong with manual rows."""
    return references.manual_problems(*_master(spark, sf_dir))


@query("""SELECT n_name AS name, n_regionkey AS region, n_nationkey AS x, 0 AS y FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT upper(n_name), n_regionkey, (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2), 1 FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0""")
def q_replace_scope(spark, sf_dir):
    """One region's block replaced in place."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").alias("_ord"))
    new = n.filter("region = '2' AND _ord % 2 = 0").withColumn("name", F.upper("name"))
    out = references.replace_scope(n, new, "region", "2")
    return out.select("name", F.col("region").cast("int").alias("region"), F.col("_x").alias("x"), F.col("_y").alias("y"))


@query("""WITH o AS (SELECT p_brand AS k, p_name AS v, p_type AS l FROM part WHERE p_partkey % 3 <> 0 AND p_brand <> 'Brand#7'), n AS (SELECT p_brand AS k, p_name AS v, p_type AS l FROM part WHERE p_partkey % 3 <> 1 AND p_brand <> 'Brand#8')
SELECT 'customer_added' AS change, k AS "key", CAST(NULL AS VARCHAR) AS value FROM (SELECT k FROM n EXCEPT SELECT k FROM o) UNION ALL SELECT 'customer_removed', k, NULL FROM (SELECT k FROM o EXCEPT SELECT k FROM n)
UNION ALL SELECT 'pair_added', k, v FROM (SELECT k, v FROM n EXCEPT SELECT k, v FROM o) UNION ALL SELECT 'pair_removed', k, v FROM (SELECT k, v FROM o EXCEPT SELECT k, v FROM n)
UNION ALL SELECT 'renamed', k, b FROM (SELECT k, min(l) AS a FROM o GROUP BY k) JOIN (SELECT k, min(l) AS b FROM n GROUP BY k) USING (k) WHERE a <> b""")
def q_import_diff(spark, sf_dir):
    """What a new export adds, removes and renames."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("k"), F.col("p_name").alias("v"), F.col("p_type").alias("l"))
    return references.import_diff(p.filter("p_partkey % 3 <> 0 AND k <> 'Brand#7'"), p.filter("p_partkey % 3 <> 1 AND k <> 'Brand#8'"), "k", "v", "l")


@query("""SELECT c_custkey, name, brand_count, configured, configured OR brand_count > 0 AS ready FROM (SELECT c_custkey, c_name AS name, coalesce(n, 0) AS brand_count, c_mktsegment = 'BUILDING' AS configured
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) ORDER BY lpad(CAST(c_custkey AS VARCHAR), 12, '0') LIMIT 50 OFFSET 10""")
def q_catalog(spark, sf_dir):
    """A page of the customer catalog."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("kunnr"), F.col("c_name").alias("name1"), F.lit(0).alias("_ord"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("kunnr"))
    page = references.catalog_page(references.catalog(c, orders, c.filter("c_mktsegment = 'BUILDING'")), offset=10, limit=50)
    return page.select(F.col("kunnr").cast("long").alias("c_custkey"), "name", "brand_count", "configured", "ready")


def _review_rows(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("file"), F.col("o_orderpriority").alias("PRIO"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("STATE"), (F.col("o_orderkey") % 13 == 0).alias("deleted"))


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS state,
CASE WHEN o_orderkey % 12 = 0 THEN true WHEN o_orderkey % 4 = 0 THEN false ELSE o_orderkey % 13 = 0 END AS deleted,
CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 40 = 0 THEN 'PRIO,STATE' ELSE 'PRIO' END ELSE '' END AS manual FROM orders""")
def q_edit_merge(spark, sf_dir):
    """Edits of a quarter of the rows; changed fields are marked, unknown rows are left out."""
    r = _review_rows(spark, sf_dir)
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0")
    k = F.col("o_orderkey")
    edits = o.select(k.alias("row_id"), F.lit("X").alias("PRIO"), F.when(k % 8 == 0, F.col("o_orderstatus")).alias("STATE"), (k % 12 == 0).alias("deleted"))
    edits = edits.unionByName(edits.limit(1).withColumn("row_id", F.lit(-1).cast("long")))
    merged, _ = review.merge_edits(r, edits, ["PRIO", "STATE"])
    return merged.select("row_id", F.col("PRIO").alias("prio"), F.col("STATE").alias("state"), "deleted", F.array_join("manual", ",").alias("manual"))


@query("""SELECT -o_orderkey AS row_id FROM orders WHERE o_orderkey % 100 = 1""")
def q_edit_rejected(spark, sf_dir):
    """Edits of rows that don't exist."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 1")
    k = F.col("o_orderkey")
    edits = o.select(F.when(k % 100 == 1, -k).otherwise(k).alias("row_id"), F.lit("X").alias("PRIO"))
    return review.merge_edits(_review_rows(spark, sf_dir), edits, ["PRIO"])[1].select("row_id")


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0 THEN 'FILLED' WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS state FROM orders""")
def q_bulk_fill(spark, sf_dir):
    """One value in all blank live cells."""
    return review.bulk_fill(_review_rows(spark, sf_dir), "STATE", "FILLED").select("row_id", F.col("STATE").alias("state"))


def _lines(spark, sf_dir) -> DataFrame:
    """Lines as review rows: file, quantity and price as text, deleted, issues."""
    i = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    issues = F.array(engine.issue("Q", "error", "ZERO", "q"), engine.issue("P", "warn", "LIKELY_MISSED", "p"))
    found = F.when(k % 10 == 0, issues).when(k % 10 == 1, F.slice(issues, 2, 1)).otherwise(F.slice(issues, 1, 0))
    qty = F.when(k % 17 == 0, F.lit("x")).when(k % 17 == 1, F.concat(F.lit("1,"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"))).otherwise(F.format_number("l_quantity", 1))
    price = F.when(k % 50 == 3, "").otherwise(F.format_number("l_extendedprice", 2))
    return i.select((F.col("l_suppkey") % 60).alias("file"), F.monotonically_increasing_id().alias("row_id"), qty.alias("QTY"), price.alias("PRICE"), (k % 11 == 0).alias("deleted"), found.alias("issues"), *TIE, "l_orderkey", "l_suppkey")


@query("""SELECT l_suppkey % 60 AS file, count(*) AS rows, sum(CASE WHEN l_partkey % 17 IN (0, 1) THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS qty,
sum(CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN l_partkey % 10 IN (0, 1) THEN 1 ELSE 0 END) AS warnings FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1""")
def q_summary(spark, sf_dir):
    """Summary by file: quantities with separators count as 0."""
    return review.summary(_lines(spark, sf_dir), "QTY", ["file"])


@query("""WITH r AS (SELECT l_suppkey % 60 AS file, CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 17 = 1 THEN 1000 + CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS q, CASE WHEN l_partkey % 50 <> 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS p FROM lineitem WHERE l_partkey % 11 <> 0),
f AS (SELECT s_suppkey AS file FROM supplier WHERE s_suppkey < 70), g AS (SELECT f.file, grouping(f.file) AS grand, count(r.file) AS n_rows, coalesce(sum(q), 0) AS qty, coalesce(sum(q * p), 0) AS amount, coalesce(sum(CASE WHEN r.file IS NOT NULL AND p IS NULL THEN 1 ELSE 0 END), 0) AS n_no_price FROM f LEFT JOIN r ON f.file = r.file GROUP BY ROLLUP (f.file))
SELECT file, CAST(grand AS INTEGER) AS grand, n_rows, CAST(CAST(qty AS DECIMAL(38,2)) AS VARCHAR) AS qty, CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR) AS amount, n_no_price, CASE WHEN file IS NULL THEN '' WHEN n_rows = file * 10 THEN 'true' ELSE 'false' END AS lines_ok FROM g""")
def q_totals_rollup(spark, sf_dir):
    """Totals by file, files without rows too, and over all."""
    s = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").filter("s_suppkey < 70").select(s.alias("file"), F.lit("1").alias("printed_qty"), F.lit("1").alias("printed_amount"), (s * 10).alias("printed_lines"), F.lit(False).alias("split"))
    t = review.totals(files, _lines(spark, sf_dir), "QTY", "PRICE")
    return t.select("file", F.col("grand").cast("int").alias("grand"), "n_rows", decimal(F.col("qty")).alias("qty"), decimal(F.col("amount")).alias("amount"), "n_no_price", "lines_ok")


@query("""WITH l AS (SELECT l_orderkey AS file, CAST(l_quantity AS DECIMAL(18,2)) AS q, CASE WHEN l_partkey % 50 <> 3 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS p, l_partkey % 11 = 0 AS deleted FROM lineitem),
s AS (SELECT file, sum(q) AS qty, sum(q * p) AS amount, count(*) AS lines FROM l WHERE NOT deleted GROUP BY 1),
f AS (SELECT file, CASE file % 3 WHEN 0 THEN qty WHEN 1 THEN qty + 1 END AS pq, CASE file % 4 WHEN 0 THEN amount WHEN 1 THEN amount + 1 END AS pa, CASE WHEN file % 7 <> 0 THEN lines + CASE WHEN file % 6 = 1 THEN 1 ELSE 0 END END AS pl, file % 5 = 0 AS split FROM s),
g AS (SELECT f.file, pq, pa, pl, split, count(*) AS n_rows, sum(q) AS qty, coalesce(sum(q * p), 0) AS amount, count(*) FILTER (WHERE p IS NULL) AS n_no_price FROM f JOIN l ON l.file = f.file AND NOT deleted GROUP BY ALL)
SELECT file, n_rows, n_no_price, CASE WHEN pq IS NULL THEN '' WHEN pq = qty THEN 'true' ELSE 'false' END AS qty_ok, CASE WHEN pa IS NULL OR n_no_price > 0 THEN '' WHEN pa = amount THEN 'true' ELSE 'false' END AS amount_ok,
CASE WHEN pl IS NULL OR split THEN '' WHEN pl = n_rows THEN 'true' ELSE 'false' END AS lines_ok FROM g""")
def q_totals_verdicts(spark, sf_dir):
    """Totals of every order as a file against what is printed on it: quantity, amount (not where a price is missing) and lines (not of split ones)."""
    i, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    price = F.when(k % 50 == 3, "").otherwise(F.format_number("l_extendedprice", 2))
    rows_ = i.select(F.col("l_orderkey").alias("file"), F.format_number("l_quantity", 1).alias("QTY"), price.alias("PRICE"), (k % 11 == 0).alias("deleted"))
    q, p = F.col("l_quantity").cast("decimal(18,2)"), F.when(k % 50 != 3, F.col("l_extendedprice").cast("decimal(18,2)"))
    sums = i.filter(k % 11 != 0).groupBy(F.col("l_orderkey").alias("file")).agg(F.sum(q).alias("qty"), F.sum(q * p).alias("amount"), F.count("*").alias("lines"))
    f = F.col("file")
    written = lambda c, n: F.format_number(F.when(f % n == 0, F.col(c)).when(f % n == 1, F.col(c) + 1), 4)
    lines = F.when(f % 7 != 0, F.col("lines") + (f % 6 == 1).cast("int"))
    files = sums.select("file", written("qty", 3).alias("printed_qty"), written("amount", 4).alias("printed_amount"), lines.alias("printed_lines"), (f % 5 == 0).alias("split"))
    return review.totals(files, rows_, "QTY", "PRICE").filter("grand = 0").select("file", "n_rows", "n_no_price", "qty_ok", "amount_ok", "lines_ok")


@query("""SELECT o_custkey AS batch_id, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderkey % 50 = 0) THEN 'PARSING' WHEN bool_or(o_orderkey % 31 = 0) THEN 'SENT' WHEN bool_or(o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) OR count(*) FILTER (WHERE o_orderkey % 5 <> 0) = 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM orders GROUP BY 1""")
def q_batch_status(spark, sf_dir):
    """Status of batches from their files and rows."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    files = o.select(F.col("o_custkey").alias("batch_id"), F.when((F.col("o_orderstatus") == "P") & (k % 50 == 0), "PARSING").when(k % 31 == 0, "SENT").otherwise("READY").alias("status"))
    bad = F.array(engine.issue("Q", "error", "ZERO", "q"))
    r = o.select(F.col("o_custkey").alias("batch_id"), (k % 5 == 0).alias("deleted"), F.when(k % 7 == 0, bad).otherwise(F.slice(bad, 1, 0)).alias("issues"))
    return review.batch_status(r, files)


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN event_type = 'click' THEN 'PARSING' ELSE event_type END AS status FROM events""")
def q_stale(spark, sf_dir):
    """Batches that have been parsing for too long are shown as failed."""
    status = F.when(F.col("event_type") == "click", "PARSING").otherwise(F.col("event_type"))
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", review.stale_status(status, F.col("ts").cast("string"), now, 30).alias("status"))


@query(f"""SELECT l_orderkey, chunk, count(*) AS n_rows, '[' || string_agg('{{"PART":"' || l_partkey || '","FLAG":"' || l_returnflag || '","NONE":""}}', ',' ORDER BY rn) || ']' AS rows FROM (
SELECT *, (rn - 1) // 3 AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, {TIE_SQL}) AS rn FROM lineitem WHERE l_partkey % 11 <> 0)) GROUP BY 1, 2""")
def q_payload_chunks(spark, sf_dir):
    """Payloads of three rows at most."""
    r = _lines(spark, sf_dir).withColumn("PART", F.col("l_partkey").cast("string")).withColumn("FLAG", F.col("l_returnflag")).withColumn("NONE", F.lit(None).cast("string"))
    return review.payload_chunks(r, ["PART", "FLAG", "NONE"], ["l_suppkey", *TIE], 3, ["l_orderkey"])


@query("""SELECT c AS o_custkey, string_agg(k, ',' ORDER BY o) AS keys FROM (SELECT o_custkey AS c, o_orderpriority AS k, min(o_orderkey) AS o FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY 1""")
def q_order_keys(spark, sf_dir):
    """Distinct order keys, first seen first."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")))
    return review.order_keys(o, "k", "o_orderkey", ["o_custkey"]).select("o_custkey", F.array_join("keys", ",").alias("keys"))


@query("""SELECT field, code, message, count(*) AS n_rows FROM (SELECT 'Q' AS field, 'ZERO' AS code, 'q' AS message FROM lineitem WHERE l_partkey % 10 = 0 UNION ALL SELECT 'P', 'LIKELY_MISSED', 'p' FROM lineitem WHERE l_partkey % 10 IN (0, 1)) GROUP BY ALL""")
def q_issue_groups(spark, sf_dir):
    """Rows by issue."""
    return review.issue_groups(_lines(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 409 WHEN o_orderkey % 3 = 1 THEN 400 WHEN o_orderkey % 5 = 0 THEN 409 WHEN o_orderkey % 7 = 0 THEN 409 ELSE 200 END AS code FROM orders""")
def q_send_gate(spark, sf_dir):
    """The first reason not to send."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "SENDING").otherwise("READY")
    return table(spark, sf_dir, "orders").select("o_orderkey", review.send_gate(status, (k % 3 == 1).cast("int"), k % 5, (k % 7 == 0).cast("int")).alias("code"))


@query("""SELECT doc_id, count(*) OVER w > 20 OR length(text) > 9000 OR sum(length(text)) OVER w > 40000 AS refused FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id % 40 ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def q_upload_limits(spark, sf_dir):
    """Files over the limits on count, size and total."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", (F.col("doc_id") % 40).alias("batch"), F.length("text").alias("n"))
    return review.upload_refused(d, "doc_id", "n", ["batch"], 20, 9000, 40_000).select("doc_id", "refused")


@query("""SELECT o_orderkey, coalesce(n, 0) = o_orderkey % 6 AS lines_ok, coalesce(q, 0) = CASE WHEN o_orderkey % 2 = 0 THEN coalesce(q, 0) ELSE 5 END AS qty_ok FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_grounding_totals(spark, sf_dir):
    """Printed totals against counted lines and quantities."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("qty "), F.col("l_quantity").cast("decimal(18,1)").cast("string"), F.lit(" EA")).alias("q"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("decimal(18,1)").alias("s"))
    k = F.col("o_orderkey")
    printed = table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left").select("o_orderkey", (k % 6).alias("line_count"), F.when(k % 2 == 0, F.concat(F.coalesce("s", F.lit(0)).cast("string"), F.lit(" PCS"))).otherwise("5").alias("total_qty"))
    return review.grounding_totals(lines, printed, "o_orderkey", "q")


@query("""SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS padded FROM customer""")
def q_pad(spark, sf_dir):
    """Left padding that never cuts."""
    return table(spark, sf_dir, "customer").select("c_custkey", pad_left(F.col("c_custkey").cast("string"), 3).alias("padded"))
