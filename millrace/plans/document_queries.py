"""Queries of document operators: lines, slices, chunks, anchors, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors, documents
from ..sources.html import html_text
from .common import query, table

_LINES = "string_split(text, chr(10))"


@query(f"""SELECT doc_id, n, 'L' || lpad(CAST(n AS VARCHAR), 6, '0') || '| ' || line AS numbered, CASE WHEN n = 1 THEN 0 ELSE 1 END AS body FROM (
SELECT doc_id, unnest(list_concat(['===== PAGE 1 ====='], {_LINES})) AS line, CAST(unnest(range(1, len({_LINES}) + 2)) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL)""")
def q_numbered_lines(spark, sf_dir):
    """Document-wide line numbers, page headers included."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array("text").alias("pages"))
    lines = documents.document_lines(docs)
    return lines.select("doc_id", "n", documents.numbered(F.col("n"), F.col("text")).alias("numbered"), (F.col("n") > 1).cast("int").alias("body"))


@query(f"""SELECT doc_id, array_to_string({_LINES}[2:4], chr(10)) AS middle, array_to_string({_LINES}[1:least(2, 3 - 1)], chr(10)) AS head FROM documents WHERE text IS NOT NULL""")
def q_slice_text(spark, sf_dir):
    """Slices of lines, clamped to the document."""
    lines = F.split("text", "\n", -1)
    head, _ = documents.excerpt(lines, F.lit(3), F.lit(5), 2)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", documents.slice_text(lines, F.lit(2), F.lit(4)).alias("middle"), head.alias("head"))


@query(f"""WITH b AS (SELECT doc_id, len({_LINES}) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, n, CAST(ceil(n / 7.0) AS INTEGER) AS parts FROM b),
c AS (SELECT doc_id, n, n // parts AS size, n % parts AS extra, unnest(range(0, parts)) AS part FROM p),
d AS (SELECT doc_id, n, part, 1 + part * size + least(part, extra) AS s, part * size + least(part, extra) + size + CASE WHEN part < extra THEN 1 ELSE 0 END AS e FROM c)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(CASE WHEN e < n THEN least(e + 2, n) END AS INTEGER) AS read_end, part > 0 AS mid_block FROM d""")
def q_chunk_plan(spark, sf_dir):
    """Documents in equal chunks of seven lines at most, with two lines of reading on."""
    blocks = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.lit(0).alias("ship_idx"), F.lit(1).alias("src"), F.size(F.split("text", "\n", -1)).alias("src_end"))
    return documents.chunk_plan(blocks, documents.line_limit(7, 16_000, 0.9, 80.0), 2).drop("ship_idx")


_BLOCKS = """SELECT conv_id AS doc_id, turn AS ship_idx, CASE WHEN turn % 11 = 10 THEN NULL ELSE turn * 10 + length(text) % 4 END AS src, CASE WHEN turn % 7 = 6 THEN turn * 10 - 5 ELSE turn * 10 + 8 + length(text) % 7 END AS src_end, 60 AS n_lines FROM conversations"""


@query(f"""WITH b AS ({_BLOCKS}), k AS (SELECT *, lag(src_end) OVER (PARTITION BY doc_id ORDER BY src, src_end, ship_idx) AS before FROM b WHERE src IS NOT NULL)
SELECT doc_id, ship_idx, 'missing' AS problem FROM b WHERE src IS NULL UNION ALL SELECT doc_id, ship_idx, 'reversed' FROM k WHERE src > src_end
UNION ALL SELECT doc_id, ship_idx, 'outside' FROM k WHERE src < 1 OR src_end > n_lines UNION ALL SELECT doc_id, ship_idx, 'overlap' FROM k WHERE before >= src""")
def q_chunk_validate(spark, sf_dir):
    """All problems of all blocks at once."""
    t, n = F.col("turn"), F.length("text")
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("ship_idx"), F.when(t % 11 != 10, t * 10 + n % 4).alias("src"), F.when(t % 7 == 6, t * 10 - 5).otherwise(t * 10 + 8 + n % 7).alias("src_end"), F.lit(60).alias("n_lines"))
    return documents.block_problems(blocks)


@query("""WITH i AS (SELECT conv_id AS doc_id, turn // 2 AS ship_idx, turn AS chunk_index, CASE WHEN turn % 5 = 4 THEN NULL ELSE (turn * 3 + length(text)) % 9 END AS src, 6 AS e, text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ship_idx, src ORDER BY chunk_index, text) AS rn FROM i WHERE src IS NULL OR NOT (src > 6 AND src <= 7))
SELECT doc_id, ship_idx, chunk_index, src, row_number() OVER (PARTITION BY doc_id, ship_idx ORDER BY chunk_index, text) AS line_no FROM k WHERE rn = 1 OR src IS NULL""")
def q_chunk_merge(spark, sf_dir):
    """Chunk results as one list: the tail goes, repeats go, lines are numbered again."""
    t = F.col("turn")
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(t / 2).alias("ship_idx"), t.alias("chunk_index"), F.lit(1).alias("start"), F.lit(6).alias("end"), F.lit(7).alias("tail_end"), F.col("text").alias("pos"), F.when(t % 5 != 4, (t * 3 + F.length("text")) % 9).alias("src"))
    return documents.merge_chunks(items).select("doc_id", "ship_idx", "chunk_index", "src", F.col("line_no").cast("long").alias("line_no"))


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""SELECT doc_id, contains({_NORM.format("text")}, v) AS found FROM (SELECT doc_id, text, {_NORM.format("regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0) || CASE WHEN doc_id % 4 = 0 THEN 'qqq' ELSE '' END")} AS v FROM documents) WHERE v <> ''""")
def q_anchor_exact(spark, sf_dir):
    """Exact anchors of values taken from texts, some of them spoilt."""
    docs = table(spark, sf_dir, "documents").withColumn("v", anchors.normalized(F.concat(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0), F.when(F.col("doc_id") % 4 == 0, "qqq").otherwise(""))))
    return docs.filter("v <> ''").select("doc_id", anchors.exact(F.col("v"), anchors.normalized(F.col("text"))).alias("found"))


@query("""SELECT item_id, CAST(len(list_intersect(w, h)) AS DOUBLE) / len(w) >= 0.6 AS fuzzy FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w,
list_distinct(regexp_extract_all(lower(substring(text, 1, 40 + CAST(item_id AS INTEGER) % 60)), '[a-z]+')) AS h FROM benchmark)""")
def q_anchor_fuzzy(spark, sf_dir):
    """Overlap of words between a value and its lines."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", " ")
    part = F.substring("text", F.lit(1), (F.col("item_id") % 60).cast("int") + 40)
    return table(spark, sf_dir, "benchmark").select("item_id", (anchors.overlap(plain(F.col("text")), plain(part)) >= anchors.FUZZY_LEAST).alias("fuzzy"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN false ELSE true END AS number_found, o_orderkey % 4 <> 3 AS date_found FROM orders""")
def q_anchor_number_date(spark, sf_dir):
    """Numeric and date anchors in lines that write them in other ways."""
    k = F.col("o_orderkey")
    value = F.concat((k + 1000).cast("string"), F.lit(".50"))
    us, eu = F.format_number(k + 1000.5, 2), F.translate(F.format_number(k + 1000.5, 2), ",.", ".,")
    money = F.when(k % 3 == 0, us).when(k % 3 == 1, eu).otherwise(F.concat(F.lit("9"), us))
    d = "o_orderdate"
    day = F.when(k % 4 == 0, F.date_format(d, "M/d/yy")).when(k % 4 == 1, F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"))).when(k % 4 == 2, F.date_format(d, "dd-MMM-yyyy")).otherwise("no date")
    needle = anchors.date_of(F.date_format(d, "yyyy-MM-dd"))
    line = F.lower(F.concat(F.lit("total "), money, F.lit(" on "), day, F.lit(" end")))
    return table(spark, sf_dir, "orders").select("o_orderkey", anchors.numeric(value, line).alias("number_found"), anchors.date_found(needle, line).alias("date_found"))


@query("""SELECT p_partkey, p_partkey % 2 = 1 AND length(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) >= 4 AS lost FROM part""")
def q_part_backstop(spark, sf_dir):
    """Part numbers that occur nowhere in their document."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x "), F.upper("p_brand"))).otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", anchors.part_backstop(F.col("p_brand"), text).alias("lost"))


@query("""SELECT vec_id, CASE WHEN label % 2 = 0 AND c < 0.7 THEN 'error' WHEN c < 0.9 THEN 'warn' END AS level FROM (SELECT vec_id, label, CAST(abs(embedding[1]) AS DOUBLE) * 4 AS c FROM embeddings)""")
def q_confidence(spark, sf_dir):
    """Confidence thresholds of required and other values."""
    c = F.abs(F.col("embedding")[0]).cast("double") * 4
    return table(spark, sf_dir, "embeddings").select("vec_id", anchors.confidence_issue(c, F.col("label") % 2 == 0).alias("level"))


@query()
def q_html_text(spark, sf_dir):
    """Text of raw pages: no scripts or styles, tables as rows of cells. No SQL twin: tested on fixtures."""
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, ship_idx, src, least(src + 2, n) AS src_end, array_to_string(lines[src:least(src + 2, n)], chr(10)) AS evidence FROM (
SELECT d.doc_id, CAST(item_id AS INTEGER) AS ship_idx, CAST(1 + item_id % len(string_split(d.text, chr(10))) AS INTEGER) AS src, CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n, string_split(d.text, chr(10)) AS lines
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)""")
def q_source_lines(spark, sf_dir):
    """The lines that values point at: a range join as a slice of the document's own lines."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")).join(b, F.col("doc_id") == F.col("item_id"))
    src = (1 + F.col("item_id") % F.size("lines")).cast("int")
    end = F.least(src + 2, F.size("lines"))
    return d.select("doc_id", F.col("item_id").cast("int").alias("ship_idx"), src.alias("src"), end.alias("src_end"), documents.slice_text(F.col("lines"), src, end).alias("evidence"))


