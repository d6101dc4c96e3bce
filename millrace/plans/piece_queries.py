"""Queries of chunks that are read in pieces, and of maps with large reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, rules
from .common import query, table

LIMIT, TAIL, DEPTH = 40, 5, 2
# What an answer was, by its range: cut off, failed, or read; every third line has an item, and the line after it again in some; ranges that begin at a
# multiple of 11 have none.
_STATE = "CASE WHEN (doc_id * 31 + a * 7 + b) % 5 < 2 THEN 'truncated' WHEN (doc_id + a + b) % 9 = 0 THEN 'failed' ELSE 'ok' END"


def _chunks(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ship_idx"), F.lit(1).alias("src"), (F.length(F.coalesce("text", F.lit(""))) % 300 + 1).alias("src_end"))
    return documents.chunk_plan(docs, LIMIT, TAIL).withColumnRenamed("part", "chunk_index")


def _answers(chunks: DataFrame) -> DataFrame:
    """An answer for each range that may be asked for, from one reading of the chunks."""
    level = ranges = F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))
    middle = lambda x: F.floor((x["a"] + x["b"]) / 2).cast("int")
    cut = lambda x: F.array(F.struct(x["a"].alias("a"), middle(x).alias("b")), F.struct((middle(x) + 1).alias("a"), x["b"].alias("b")))
    for _ in range(DEPTH):
        level = F.flatten(F.transform(F.filter(level, lambda x: x["a"] < x["b"]), cut))
        ranges = F.concat(ranges, level)
    asked = chunks.select("doc_id", F.explode(ranges).alias("x")).select("doc_id", "x.*")
    return asked.select("doc_id", F.col("a").alias("start"), F.col("b").alias("end"), F.expr(_STATE).alias("state"))


def _items(answers: DataFrame) -> DataFrame:
    lines = F.filter(F.sequence("start", F.col("end") + TAIL), lambda i: (i % 3 == 0) | ((i % 3 == 1) & (F.col("doc_id") % 2 == 0)))
    src = lambda i: F.when(i % 3 == 1, i - 1).otherwise(i)
    read = answers.filter("state = 'ok' AND start % 11 <> 0")
    return read.select("doc_id", "start", "end", F.posexplode(F.transform(lines, src)).alias("pos", "src"))


_PIECES_SQL = f"""b AS (SELECT doc_id, length(coalesce(text, '')) % 300 + 1 AS n FROM documents), k AS (SELECT doc_id, n, (n + {LIMIT - 1}) // {LIMIT} AS parts FROM b),
c AS (SELECT doc_id, n, i AS chunk_index, 1 + i * (n // parts) + least(i, n % parts) AS a, 1 + (i + 1) * (n // parts) + least(i + 1, n % parts) - 1 AS b FROM k, LATERAL (SELECT unnest(range(parts)) AS i)),
t AS (SELECT doc_id, chunk_index, a, b, CASE WHEN b < n THEN least(b + {TAIL}, n) ELSE b END AS base, 0 AS depth FROM c
UNION ALL SELECT t.doc_id, chunk_index, CASE WHEN h = 0 THEN a ELSE (a + b) // 2 + 1 END, CASE WHEN h = 0 THEN (a + b) // 2 ELSE b END, base, depth + 1 FROM t, (VALUES (0), (1)) v(h) WHERE depth < {DEPTH} AND a < b AND {_STATE} = 'truncated'),
p AS (SELECT *, {_STATE} <> 'ok' AS failed, CASE WHEN b < base THEN least(b + {TAIL}, base) ELSE b END AS tail_end FROM t WHERE NOT (depth < {DEPTH} AND a < b AND {_STATE} = 'truncated')),
r AS (SELECT doc_id, chunk_index, a, b, i AS spot, CASE WHEN i % 3 = 1 THEN i - 1 ELSE i END AS src FROM p, LATERAL (SELECT unnest(range(a, b + {TAIL + 1})) AS i) WHERE NOT failed AND a % 11 <> 0 AND (i % 3 = 0 OR i % 3 = 1 AND doc_id % 2 = 0)),
q AS (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id, src ORDER BY r.chunk_index, r.a, spot) AS rn FROM r JOIN p ON p.doc_id = r.doc_id AND p.a = r.a AND p.b = r.b WHERE NOT (src > p.b AND src <= tail_end))"""


@query(f"""WITH RECURSIVE {_PIECES_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, a, spot) AS INTEGER) AS line_no, CAST(src AS INTEGER) AS src FROM q WHERE rn = 1""")
def q_piece_lines(spark, sf_dir):
    """Lines of documents whose chunks were cut off and read by halves; pieces that fail at the last depth are lost alone."""
    chunks = _chunks(spark, sf_dir)
    answers = _answers(chunks)
    lines, _ = documents.merge_pieces(documents.read_pieces(chunks, answers, TAIL, DEPTH), _items(answers))
    return lines.select("doc_id", "line_no", "src")


@query(f"""WITH RECURSIVE {_PIECES_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", 'error' AS severity, 'CHUNK_FAILED' AS code, 1 AS times FROM p WHERE failed
UNION ALL SELECT doc_id, chunk_index, a, b, 'warn', 'EMPTY_CHUNK', 1 FROM p WHERE NOT failed AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND r.a = p.a AND r.b = p.b)
UNION ALL SELECT doc_id, chunk_index, a, b, 'warn', 'DUPLICATE_LINE', count(*) FROM q WHERE rn > 1 GROUP BY ALL""")
def q_piece_issues(spark, sf_dir):
    """Failed and empty pieces, and lines that were read twice."""
    chunks = _chunks(spark, sf_dir)
    answers = _answers(chunks)
    _, issues = documents.merge_pieces(documents.read_pieces(chunks, answers, TAIL, DEPTH), _items(answers))
    return issues.groupBy("doc_id", "chunk_index", "start", "end", "severity", "code").agg(F.count("*").alias("times"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Order of ' || p_name || ' ' || l_partkey || (l_linenumber % 3) AS src FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT p_partkey AS o, CASE WHEN p_partkey % 500 = 7 THEN CAST(p_partkey % 10 AS VARCHAR) ELSE p_name || ' ' || p_partkey END AS needle, p_brand AS v, false AS whole FROM part
UNION ALL SELECT p_partkey, 'order of ' || p_name || ' ' || p_partkey || '1', 'whole', true FROM part WHERE p_partkey % 10 = 3),
d AS (SELECT DISTINCT src FROM s), f AS (SELECT src, arg_min(v, (-length(needle), o, needle)) AS code FROM d JOIN n ON CASE WHEN whole THEN lower(src) = lower(needle) ELSE contains(lower(src), lower(needle)) END GROUP BY 1)
SELECT l_orderkey, l_linenumber, code, count(*) AS times FROM s LEFT JOIN f ON f.src = s.src GROUP BY ALL""")
def q_csv_map_large(spark, sf_dir):
    """A map by a reference table with a row for each part: the longest needle that a source holds, without case, or equals."""
    part = table(spark, sf_dir, "part")
    short = F.when(F.col("p_partkey") % 500 == 7, (F.col("p_partkey") % 10).cast("string")).otherwise(F.concat_ws(" ", "p_name", "p_partkey"))
    held = part.select(F.col("p_partkey").alias("_ord"), short.alias("needle"), F.col("p_brand").alias("v"), F.lit("contains").alias("mode"))
    equal = part.filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("_ord"), F.concat(F.lit("order of "), F.concat_ws(" ", "p_name", "p_partkey"), F.lit("1")).alias("needle"), F.lit("whole").alias("v"), F.lit("equals").alias("mode"))
    lines = table(spark, sf_dir, "lineitem").join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    source = F.concat(F.lit("Order of "), F.concat_ws(" ", "p_name", "l_partkey"), (F.col("l_linenumber") % 3).cast("string"))
    out = rules.csv_map_table(lines, held.unionByName(equal), source, "code", "needle", "v", mode_column="mode", longest_first=True, insensitive=True)
    return out.groupBy("l_orderkey", "l_linenumber", "code").agg(F.count("*").alias("times"))
