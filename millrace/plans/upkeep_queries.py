"""Queries of payloads, and of the upkeep of reference tables and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine, upkeep
from .common import TIE_SQL, query, rows, table, value
from .review_queries import _MANUAL_SQL, _MASTER_SQL, _master
from .rule_queries import order_lines


def payloads(spark, sf_dir) -> DataFrame:
    """JSON payloads of orders: lines of one supplier are a shipment, but orders of status P have their lines without shipments, and those
    of status F are broken off."""
    lines = order_lines(spark, sf_dir)
    line = F.struct(F.col("line_no").alias("n"), value(F.col("l_partkey")).alias("item_code"), value(F.col("l_quantity")).alias("quantity"))
    units = lines.groupBy("l_orderkey", "ship_idx", "l_suppkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    shipment = F.struct(F.col("ship_idx").alias("n"), value(F.col("l_suppkey")).alias("shipment_no"), "lines")
    trees = units.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(shipment)).alias("shipments")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    header = F.struct(value(F.col("o_orderkey")).alias("po_number"))
    flat = F.to_json(F.struct(header.alias("header"), F.flatten(F.transform("shipments", lambda s: s["lines"])).alias("lines")))
    deep = F.to_json(F.struct(header.alias("header"), "shipments"))
    return trees.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", flat).when(F.col("o_orderstatus") == "F", F.concat(F.lit("{"), deep)).otherwise(deep).alias("payload"))


@query(f"""WITH l AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS s, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {TIE_SQL}) AS n,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, {TIE_SQL}) AS m FROM lineitem)
SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE s END AS INTEGER) AS ship_idx, CAST(CASE WHEN o_orderstatus = 'P' THEN m ELSE n END AS INTEGER) AS line_no,
CAST(o_orderkey AS VARCHAR) AS po_number, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS shipment_no, CAST(l_partkey AS VARCHAR) AS item
FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def q_payload_rows(spark, sf_dir):
    """Payloads parsed to typed trees and split to rows; payloads that can't be read give none."""
    items = engine.split_orders(engine.parse_payload(payloads(spark, sf_dir)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return items.select("doc_id", "ship_idx", "line_no", text("header.po_number.value").alias("po_number"), text("shipment.shipment_no.value").alias("shipment_no"), text("line.item_code.value").alias("item"))


@query("""SELECT o_orderkey AS doc_id, 'lines' AS field, 'NO_LINES' AS code FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def q_no_lines(spark, sf_dir):
    """Documents without a line."""
    return upkeep.no_lines(engine.parse_payload(payloads(spark, sf_dir)))


@query("""SELECT p_partkey, p_brand, p_type FROM part p WHERE trim(p_type) <> '' AND NOT EXISTS (SELECT 1 FROM part r WHERE r.p_retailprice >= 1500 AND r.p_brand = p.p_brand AND r.p_type = p.p_type)""")
def q_value_check(spark, sf_dir):
    """Values that aren't registered for their customer; registered are those of a price of 1,500 or more."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    registry = part.filter("p_retailprice >= 1500").select("p_brand", "p_type")
    return upkeep.unregistered(part.drop("p_retailprice"), registry, "p_brand", "p_type")


EDITS = [("NATION_3", "A", "", 1), ("NATION_4", "", " ", 2), ("NEW", "B", "x", 3), ("", "C", "y", 4), ("NATION_3", "D", "z", 5), ("GONE", "", "", 6)]
_EDITS_SQL = "(VALUES " + ", ".join(repr(e) for e in EDITS) + ") AS e(n_name, cond, kind, ord)"


@query(f"""WITH e AS (SELECT n_name, trim(arg_max(cond, ord)) AS cond, trim(arg_max(kind, ord)) AS kind, max(ord) AS ord FROM {_EDITS_SQL} WHERE n_name <> '' GROUP BY 1),
u AS (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS cond, '' AS kind, 0 AS f, n_nationkey AS o FROM nation WHERE n_name NOT IN (SELECT n_name FROM e)
UNION ALL SELECT e.n_name, cond, kind, CASE WHEN n_nationkey IS NULL THEN 1 ELSE 0 END, coalesce(n_nationkey, ord) FROM e LEFT JOIN nation n ON e.n_name = n.n_name WHERE cond || kind <> '')
SELECT n_name, cond, kind, row_number() OVER (ORDER BY f, o) AS place FROM u""")
def q_set_rows(spark, sf_dir):
    """Single rows of a table kept by hand replaced, added and deleted."""
    from pyspark.sql import Window

    old = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("cond"), F.lit("").alias("kind"), F.col("n_nationkey").alias("_ord"))
    out = upkeep.set_rows(old, rows(spark, "n_name string, cond string, kind string, _ord long", *EDITS), "n_name", ["cond", "kind"])
    # The table has a row for each customer and is kept by hand, so that one task can number it.
    return out.select("n_name", "cond", "kind", F.row_number().over(Window.orderBy("_new", "_ord")).cast("long").alias("place"))


@query(f"""WITH p AS (SELECT DISTINCT kunnr, zbrand FROM {_MASTER_SQL}), m AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.kunnr = m.kunnr AND p.zbrand = m.zbrand) AS here FROM {_MANUAL_SQL})
SELECT CASE action WHEN 'override' THEN 'broken' WHEN 'suppress' THEN 'stale' ELSE 'landed' END AS note, kunnr, zbrand FROM m WHERE action = 'add' AND here OR action <> 'add' AND NOT here""")
def q_import_notes(spark, sf_dir):
    """Manual corrections that an import makes doubtful."""
    new, manual = _master(spark, sf_dir)
    return upkeep.correction_notes(new, manual, ["kunnr", "zbrand"])


@query("""SELECT trim(coalesce(lang, '')) AS lang, CASE WHEN trim(coalesce(source, '')) = '' THEN 'none' ELSE trim(source) END AS source, count(*) AS n FROM documents WHERE trim(coalesce(lang, '')) || trim(coalesce(source, '')) <> '' GROUP BY ALL""")
def q_sheet_records(spark, sf_dir):
    """Rows of a sheet, less blank ones, with blanks filled."""
    records = upkeep.sheet_records(table(spark, sf_dir, "documents"), {"lang": "lang", "source": "source"}, {"source": "none"})
    return records.groupBy("lang", "source").agg(F.count("*").alias("n"))


_USED_SQL = "(SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day, CAST(o_orderkey % 7 AS INTEGER) AS n FROM orders)"


@query(f"""WITH u AS (SELECT * FROM {_USED_SQL} WHERE n BETWEEN 1 AND 9999), f AS (SELECT day, min(n + 1) AS k FROM (SELECT day, 0 AS n FROM u UNION SELECT day, n FROM u) c
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.day = c.day AND u.n = c.n + 1) GROUP BY day) SELECT day, printf('b_%s_%04d', day, k) AS batch_id FROM f""")
def q_next_ids(spark, sf_dir):
    """The next free batch identifier of each day."""
    used = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), (F.col("o_orderkey") % 7).alias("n"))
    return upkeep.next_ids(used, "day", "n")


@query("""SELECT page_id, printf('f%d__', page_id) || CASE WHEN s = '' THEN 'upload' ELSE s END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s FROM pages)""")
def q_upload_names(spark, sf_dir):
    """Safe names of uploads."""
    return table(spark, sf_dir, "pages").select("page_id", upkeep.upload_name(F.format_string("f%d", "page_id"), F.col("url")).alias("name"))


@query("""SELECT event_type, count(*) FILTER (WHERE CASE WHEN event_type = 'error' THEN event_type = 'Timeout' ELSE user_id % 600 = 429 OR user_id % 600 >= 500 END) AS transient,
count(*) FILTER (WHERE event_type NOT IN ('click')) AS open FROM events GROUP BY 1""")
def q_transient(spark, sf_dir):
    """Failures that may pass, by status or name, and states that allow validation."""
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") != "error", F.col("user_id") % 600))
    state = F.when(F.col("event_type") == "click", "SENT").otherwise("READY")
    return e.groupBy("event_type").agg(F.count_if(upkeep.is_transient(F.col("status"), F.col("event_type"))).alias("transient"), F.count_if(upkeep.may_validate(state)).alias("open"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS page, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k, 1 + len(string_split(page, chr(10))) AS size FROM p), e AS (SELECT doc_id, k, sum(size) OVER (PARTITION BY doc_id ORDER BY k) AS last FROM c)
SELECT d.doc_id, CAST(min(k) AS INTEGER) AS page FROM (SELECT doc_id, CAST(length(text) % 40 + 1 AS INTEGER) AS src FROM documents) d LEFT JOIN e ON e.doc_id = d.doc_id AND e.last >= d.src GROUP BY 1""")
def q_stamp_pages(spark, sf_dir):
    """The page of the line that a value points at; stretches between blank lines are pages."""
    from ..operators.documents import document_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n\n", -1).alias("pages"), (F.length("text") % 40 + 1).cast("int").alias("src"))
    return upkeep.stamp_pages(docs.select("doc_id", "src"), document_lines(docs)).select("doc_id", "page")
