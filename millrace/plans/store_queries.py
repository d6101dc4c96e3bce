"""Queries of stored responses, of replacements that are checked first, and of hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hints, references, upkeep
from ..sources import readers, sinks
from .common import query, table


def _requests(spark, sf_dir) -> DataFrame:
    """A request for each document's text, as a file of its source."""
    docs = table(spark, sf_dir, "documents")
    customer, file = F.coalesce("source", F.lit("NONE")), F.format_string("in/%d of (%s).HTM", "doc_id", F.coalesce("lang", F.lit("?")))
    key = readers.response_key(F.col("text"), F.lit("lines"), F.lit("v3"), customer, F.lit("m"))
    return docs.select("doc_id", key.alias("key"), readers.response_name(customer, file).alias("file_name"), readers.response_name(customer, file, "c0").alias("part_name"))


_REQUEST_SQL = """r AS (SELECT doc_id, sha256(coalesce(text, '') || chr(0) || 'lines' || chr(0) || 'v3' || chr(0) || coalesce(source, 'NONE') || chr(0) || 'm') AS key,
lower(coalesce(source, 'NONE')) || '__' || doc_id || '_of_' || CASE WHEN lang IS NULL THEN '.HTM' ELSE lang || '_.HTM' END AS stem FROM documents)"""


@query(f"""WITH {_REQUEST_SQL.replace("'_of_' || CASE WHEN lang IS NULL THEN '.HTM' ELSE lang || '_.HTM' END", "CASE WHEN lang IS NULL THEN '_of_.HTM' ELSE '_of_' || lang || '_.HTM' END")},
k AS (SELECT key, min(doc_id) AS first FROM r WHERE doc_id % 3 = 0 AND doc_id % 11 <> 5 GROUP BY 1)
SELECT doc_id, stem || '.json' AS file_name, CASE WHEN doc_id % 7 = 0 THEN 'file' WHEN doc_id % 5 = 0 THEN 'part' WHEN first IS NOT NULL THEN 'store' END AS origin,
CASE WHEN doc_id % 7 = 0 THEN 'f' || doc_id WHEN doc_id % 5 = 0 THEN 'p' || doc_id WHEN first IS NOT NULL THEN printf('s%09d', first) END AS payload FROM r LEFT JOIN k ON k.key = r.key""")
def q_response_lookup(spark, sf_dir):
    """The response of each request: kept by the file's name, by its part's, or in the store under what was sent; responses that were cut off aren't stored."""
    r = _requests(spark, sf_dir)
    whole = r.filter("doc_id % 7 = 0").select(F.col("file_name").alias("name"), F.concat(F.lit("f"), "doc_id").alias("payload"))
    part = r.filter("doc_id % 5 = 0").select(F.col("part_name").alias("name"), F.concat(F.lit("p"), "doc_id").alias("payload"))
    sent = r.filter("doc_id % 3 = 0").select("key", F.format_string("s%09d", "doc_id").alias("payload"), F.when(F.col("doc_id") % 11 == 5, "max_tokens").alias("stop_reason"))
    return readers.find_responses(r, whole.unionByName(part), sinks.new_responses(sent)).select("doc_id", "file_name", "origin", "payload")


@query(f"""WITH {_REQUEST_SQL}, old AS (SELECT DISTINCT key FROM r WHERE doc_id % 4 = 1) SELECT key, printf('s%09d', min(doc_id)) AS payload FROM r WHERE doc_id % 11 <> 5 AND key NOT IN (SELECT key FROM old) GROUP BY 1""")
def q_new_responses(spark, sf_dir):
    """What a second save adds to the store: whole responses under keys that it hasn't, once each."""
    r = _requests(spark, sf_dir)
    sent = r.select("key", F.format_string("s%09d", "doc_id").alias("payload"), F.when(F.col("doc_id") % 11 == 5, "max_tokens").alias("stop_reason"))
    return sinks.new_responses(sent, r.filter("doc_id % 4 = 1").select("key")).select("key", "payload")


@query("""WITH r AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 50 = 3 THEN ' ' ELSE p_brand || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END END AS kunnr, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS cond, CASE WHEN p_partkey % 20 = 5 THEN p_name ELSE ' ' END AS kind FROM part),
c AS (SELECT place, trim(kunnr) AS kunnr, trim(cond) AS cond, trim(kind) AS kind FROM r WHERE trim(kunnr) || trim(cond) || trim(kind) <> ''), f AS (SELECT *, min(place) OVER (PARTITION BY kunnr) AS first FROM c WHERE cond || kind <> '' AND kunnr <> '')
SELECT place, 'no_key' AS problem, '' AS value FROM c WHERE kunnr = '' UNION ALL SELECT place, 'too_long:cond', cond FROM c WHERE length(cond) > 5
UNION ALL SELECT place, 'too_long:kind', kind FROM c WHERE length(kind) > 9 UNION ALL SELECT place, 'duplicate', kunnr FROM f WHERE place > first""")
def q_replacement_problems(spark, sf_dir):
    """Why a table isn't replaced: rows without a key, texts that are too long, keys twice; rows without a value only delete."""
    brand = F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 50 == 3, " ").otherwise(brand).alias("kunnr"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("cond"), F.when(F.col("p_partkey") % 20 == 5, F.col("p_name")).otherwise(" ").alias("kind")
    )
    return sinks.replacement_problems(rows, "kunnr", {"cond": 5, "kind": 9})


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t, doc_id % 9 <> 4 AS has_text FROM documents),
w AS (SELECT source, string_split(regexp_replace(arg_min(t, doc_id), '[^a-z ]', '', 'g'), ' ') AS w FROM d WHERE length(t) > 200 AND source <> '' GROUP BY 1),
p AS (SELECT source, 1 AS i, w[1] AS text, w[1] AS whole, w[1] AS label, false AS example FROM w UNION ALL SELECT source, 2, w[2] || w[3] || ': 12,5', w[2] || w[3] || ': 12,5', w[2] || w[3], false FROM w
UNION ALL SELECT source, 3, w[4] || ':  10972', w[4] || ': 10972', w[4], false FROM w UNION ALL SELECT source, 4, w[5] || w[6], w[5] || w[6], '', true FROM w),
q AS (SELECT source, text, arg_min(whole, i) AS whole, arg_min(label, i) AS label, arg_min(example, i) AS example, min(i) AS i FROM p WHERE length(text) >= 3 GROUP BY source, text),
s AS (SELECT d.doc_id, q.i, q.text, CASE WHEN example THEN CASE WHEN contains(t, whole) THEN 'example' ELSE '' END WHEN contains(t, whole) THEN 'found' WHEN length(label) >= 3 AND contains(t, label) THEN 'partial' ELSE 'missing' END AS state FROM d JOIN q ON q.source = d.source AND has_text),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE state = 'found') AS f, count(*) FILTER (WHERE state = 'partial') AS k, count(*) FILTER (WHERE state = 'missing') AS m, string_agg(text, '|' ORDER BY i) FILTER (WHERE state = 'example') AS e, string_agg(text, '|' ORDER BY i) FILTER (WHERE state = 'missing') AS missing FROM s GROUP BY 1)
SELECT d.doc_id, CASE WHEN NOT has_text THEN 'scan' WHEN n IS NULL THEN 'no_hints' WHEN f + k = 0 THEN 'none_found' WHEN m > 0 THEN 'some_missing' ELSE 'ready' END AS verdict, CAST(coalesce(f, 0) AS INTEGER) AS n_found, CAST(coalesce(k, 0) AS INTEGER) AS n_partial, coalesce(missing, '') AS missing, coalesce(e, '') AS examples
FROM d LEFT JOIN a ON a.doc_id = d.doc_id""")
def q_hint_check(spark, sf_dir):
    """Which quoted labels of a customer's hints stand in each of its documents; the hints quote words of a source's first long document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("customer"), "text", (F.col("doc_id") % 9 != 4).alias("has_text"))
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    first = docs.withColumn("t", plain).filter("length(t) > 200 AND customer <> ''").groupBy("customer").agg(F.min_by("t", "doc_id").alias("t"))
    w = lambda i: F.get(F.split(F.regexp_replace("t", "[^a-z ]", ""), " "), F.lit(i - 1))
    text = F.concat(F.lit('Read "'), w(1), F.lit('"\n and "'), w(2), w(3), F.lit(': 12,5".\n "'), w(4), F.lit(':  10972"\n e.g. : "'), w(5), w(6), F.lit('"'))
    found = hints.check_hints(docs, first.select("customer", text.alias("hints")))
    return found.select("doc_id", "verdict", F.size("found").alias("n_found"), F.size("partial").alias("n_partial"), F.array_join("missing", "|").alias("missing"), F.array_join("examples", "|").alias("examples"))


@query("""WITH b AS (SELECT p_brand AS kunnr, p_type AS zbrand, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name1, p_partkey AS o FROM part),
k AS (SELECT s_suppkey AS book, 'Brand#' || (s_suppkey % 40) AS kunnr, CASE WHEN s_suppkey % 2 = 0 THEN 'red ring' ELSE 'hot gear' END AS name FROM supplier),
m AS (SELECT CASE WHEN p_partkey % 70 = 0 THEN '' ELSE p_brand END AS kunnr, CASE WHEN p_partkey % 20 = 0 THEN p_type ELSE 'NEW' || p_partkey END AS zbrand, CASE p_partkey % 4 WHEN 0 THEN 'suppress' WHEN 1 THEN 'add' WHEN 2 THEN 'override' END AS action, CASE WHEN p_partkey % 30 = 5 THEN ' ' ELSE 'n' END AS note FROM part WHERE p_partkey % 5 = 0),
g AS (SELECT * FROM m WHERE kunnr <> ''), r AS (SELECT kunnr, zbrand FROM b EXCEPT SELECT kunnr, zbrand FROM g WHERE action = 'suppress' UNION SELECT kunnr, zbrand FROM g WHERE action = 'add'),
u AS (SELECT DISTINCT book, kunnr, v FROM (SELECT book, kunnr, p_type AS v FROM k JOIN part ON p_partkey = book UNION ALL SELECT book, kunnr, 'NEW' || (book * 5) FROM k)),
n AS (SELECT kunnr, arg_min(name1, o) AS name1 FROM b WHERE name1 <> '' GROUP BY 1)
SELECT 10 AS "check", 'error' AS level, 'book ' || book AS place, 'not registered: ' || v AS message FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.kunnr = u.kunnr AND r.zbrand = u.v)
UNION ALL SELECT 11, 'warn', 'book ' || book, 'no row of customer ' || kunnr FROM k WHERE kunnr NOT IN (SELECT kunnr FROM b) UNION ALL SELECT 15, 'warn', 'book ' || book, name || ' is ' || name1 || ' there' FROM k JOIN n ON n.kunnr = k.kunnr WHERE name1 <> name
UNION ALL SELECT 16, 'report', 'book ' || book, c || ' to choose from' FROM k JOIN (SELECT kunnr, count(*) AS c FROM r GROUP BY 1) x ON x.kunnr = k.kunnr WHERE c > 1
UNION ALL SELECT 17, 'error', kunnr || '/' || zbrand, 'unknown action or no note' FROM m WHERE action IS NULL OR trim(note) = '' UNION ALL SELECT 18, 'error', kunnr || '/' || zbrand, 'nothing to ' || action FROM g WHERE action IN ('override', 'suppress') AND NOT EXISTS (SELECT 1 FROM b WHERE b.kunnr = g.kunnr AND b.zbrand = g.zbrand)
UNION ALL SELECT 19, 'report', kunnr || '/' || zbrand, coalesce(action, '') FROM m""")
def q_reference_report(spark, sf_dir):
    """Reference tables against rule books: values that aren't registered, customers without rows, other names, choices, and manual corrections."""
    from ..operators.validation import reference_report

    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    brands = part.select(F.col("p_brand").alias("kunnr"), F.col("p_type").alias("zbrand"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name1"), k.alias("_ord"))
    number = F.col("s_suppkey")
    books = table(spark, sf_dir, "supplier").select(number.alias("book"), F.concat(F.lit("Brand#"), (number % 40).cast("string")).alias("customer_no"), F.when(number % 2 == 0, "red ring").otherwise("hot gear").alias("name"))
    manual = part.filter("p_partkey % 5 = 0").select(
        F.when(k % 70 == 0, "").otherwise(F.col("p_brand")).alias("kunnr"), F.when(k % 20 == 0, F.col("p_type")).otherwise(F.concat(F.lit("NEW"), k.cast("string"))).alias("zbrand"),
        F.when(k % 4 == 0, "suppress").when(k % 4 == 1, "add").when(k % 4 == 2, "override").alias("action"), F.when(k % 30 == 5, " ").otherwise("n").alias("note"), k.alias("_ord"),
    )
    types = books.join(part, F.col("book") == k).select("book", "customer_no", F.col("p_type").alias("value"))
    outputs = types.unionByName(books.select("book", "customer_no", F.concat(F.lit("NEW"), (F.col("book") * 5).cast("string")).alias("value")))
    return reference_report(books, brands, manual, outputs)


def _corrections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as a brand table of customers, and corrections of it."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    master = part.select((k % 300).cast("string").alias("kunnr"), F.concat_ws("/", "p_brand", "p_type").alias("zbrand"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name1"), k.alias("_ord"))
    action = F.when(k % 4 == 0, "suppress").when(k % 4 == 1, "add").otherwise("override")
    manual = part.filter("p_partkey % 6 < 2").select(
        F.when(k % 70 == 0, "").otherwise((k % 300).cast("string")).alias("kunnr"), F.when(k % 4 == 1, F.concat(F.lit("N"), k.cast("string"))).otherwise(F.concat_ws("/", "p_brand", "p_type")).alias("zbrand"), F.lit("").alias("name1"), action.alias("action"), k.alias("_ord")
    )
    return master, manual


_CORRECTIONS_SQL = """b AS (SELECT CAST(p_partkey % 300 AS VARCHAR) AS kunnr, p_brand || '/' || p_type AS zbrand, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name1, p_partkey AS o FROM part),
m AS (SELECT CASE WHEN p_partkey % 70 = 0 THEN '' ELSE CAST(p_partkey % 300 AS VARCHAR) END AS kunnr, CASE WHEN p_partkey % 4 = 1 THEN 'N' || p_partkey ELSE p_brand || '/' || p_type END AS zbrand, CASE p_partkey % 4 WHEN 0 THEN 'suppress' WHEN 1 THEN 'add' ELSE 'override' END AS action FROM part WHERE p_partkey % 6 < 2)"""


@query(f"WITH {_CORRECTIONS_SQL} SELECT kunnr, zbrand FROM (SELECT kunnr, zbrand FROM b EXCEPT SELECT kunnr, zbrand FROM m WHERE kunnr <> '' AND action = 'suppress') UNION SELECT kunnr, zbrand FROM m WHERE kunnr <> '' AND action = 'add'")
def q_registered_codes(spark, sf_dir):
    """The codes that each customer may get, after manual corrections."""
    return references.registered_codes(*_corrections(spark, sf_dir))


@query(f"""WITH {_CORRECTIONS_SQL}, k AS (SELECT CAST(s_suppkey AS VARCHAR) AS kunnr, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name, 'C' || s_suppkey AS code FROM supplier WHERE s_suppkey % 2 = 0),
c AS (SELECT b.kunnr, coalesce(arg_min(CASE WHEN name1 <> '' THEN name1 END, CASE WHEN name1 <> '' THEN o END), '') AS sap_name, count(*) AS brand_count FROM b GROUP BY 1), n AS (SELECT kunnr, count(*) AS manual_count FROM m GROUP BY 1),
e AS (SELECT c.kunnr, CASE WHEN coalesce(k.name, '') <> '' THEN k.name WHEN sap_name <> '' THEN sap_name ELSE '(' || c.kunnr || ')' END AS name, sap_name, coalesce(code, '') AS code, brand_count, coalesce(manual_count, 0) AS manual_count FROM c LEFT JOIN k ON k.kunnr = c.kunnr LEFT JOIN n ON n.kunnr = c.kunnr),
f AS (SELECT * FROM e WHERE contains(lower(name), 'r') OR contains(lower(sap_name), 'r') OR contains(lower(kunnr), 'r') OR contains(lower(code), 'r'))
SELECT 'name' AS sort, * FROM (SELECT * FROM f ORDER BY lower(name), kunnr LIMIT 60) UNION ALL SELECT 'kunnr', * FROM (SELECT * FROM e WHERE code <> '' ORDER BY lpad(kunnr, 12, '0') LIMIT 60) UNION ALL SELECT 'ready', * FROM (SELECT * FROM e WHERE code = '' ORDER BY lower(name), kunnr LIMIT 60)""")
def q_catalog_entries(spark, sf_dir):
    """Pages of the customer catalog in its three orders: searched by name or code, with a rule book of their own, and without."""
    master, manual = _corrections(spark, sf_dir)
    number = F.col("s_suppkey")
    books = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(number.cast("string").alias("customer_no"), F.when(number % 5 == 0, "").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("C"), number.cast("string")).alias("code"))
    out = None
    for sort, text, scope in (("name", "R", "all"), ("kunnr", "", "configured"), ("ready", "", "unconfigured")):
        page = references.customer_catalog(master, manual, books, text, scope, sort).limit(60).select(F.lit(sort).alias("sort"), "kunnr", "name", "sap_name", "code", "brand_count", "manual_count")
        out = page if out is None else out.unionByName(page)
    return out


@query("""SELECT doc_id, sha256('{"BSTKD": "' || doc_id || '", "LANG": ' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ', "TEXT": ' || to_json(coalesce(text, '')) || '}') AS digest FROM documents""")
def q_payload_digest(spark, sf_dir):
    """The digest of a payload, whatever order its keys come in."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sinks.payload_digest(sinks.sorted_json({"TEXT": F.coalesce("text", F.lit("")), "BSTKD": F.col("doc_id").cast("string"), "LANG": F.col("lang")})).alias("digest"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE page_id % 3 WHEN 0 THEN ['HTML', 'pdf'] WHEN 1 THEN ['pdf'] ELSE [] END AS allowed FROM pages)
SELECT page_id, ext, CASE WHEN page_id % 3 = 1 AND ext <> 'pdf' OR page_id % 3 = 0 AND ext NOT IN ('html', 'pdf') THEN 'UNEXPECTED_FILE_TYPE' END AS code FROM p""")
def q_file_types(spark, sf_dir):
    """A warning where a customer sends another kind of file than its rule book names; a book that names none takes all."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id") % 3
    allowed = F.when(k == 0, F.array(F.lit("HTML"), F.lit("pdf"))).when(k == 1, F.array(F.lit("pdf"))).otherwise(F.array().cast("array<string>"))
    ext = upkeep.extension(F.col("url"))
    return pages.select("page_id", ext.alias("ext"), upkeep.unexpected_type(ext, allowed).alias("code"))
