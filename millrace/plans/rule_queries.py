"""Queries of the rule engine: splitting, tables, rules, expressions, formats, fields, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_text, compile_expr
from ..functions.formats import apply_format
from ..functions.text import OPS, casefold, collapse_spaces, strip
from ..operators import engine, rules
from .common import TIE, TIE_SQL, query, rows, table, value

_ORDERED = f"row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {TIE_SQL})"


def order_lines(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """Lines of orders, or those given with the columns of lineitem, as items: doc_id, ship_idx (supplier's rank in the order), line_no. One
    shuffle and one sort serve both."""
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    numbered = lines.repartition("l_orderkey").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*TIE)))
    return numbered.withColumn("ship_idx", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey")))


@query(f"""SELECT l_orderkey AS doc_id, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS INTEGER) AS ship_idx,
CAST({_ORDERED} AS INTEGER) AS line_no, l_partkey,
printf('r_%04d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, {TIE_SQL})) AS row_id FROM lineitem""")
def q_split_orders(spark, sf_dir):
    """SPLIT: order units by supplier, line numbers and row ids."""
    order = Window.partitionBy("l_orderkey").orderBy("ship_idx", "line_no")
    return order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), "ship_idx", "line_no", "l_partkey", F.format_string("r_%04d", F.row_number().over(order)).alias("row_id"))


@query("""SELECT o_orderkey AS doc_id, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''), nullif(n_name, ''), '') AS grp
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def q_group_label(spark, sf_dir):
    """The configured group label, else the receiving location."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.withColumn("header", F.struct(value(F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))).alias("order_text"))).withColumn("shipment", F.struct(value(F.col("n_name")).alias("receiving_loc")))
    return o.select(F.col("o_orderkey").alias("doc_id"), engine.group_label(engine.Scope({}, o), "header.order_text").alias("grp"))


# A literal decision table: nation and segment decide on plant and remark.
DECISION = {
    "name": "routing",
    "columns": [{"source": "header.segment", "op": "contains_ci"}, {"source": "header.nation", "fallback_source": "header.name", "op": "regex", "normalize": ["trim", "upper"]}],
    "rows": [
        {"when": ["machin", r"^NATION_1\d?$"], "set": {"WERKS": "1100", "_kind": "heavy"}},
        {"when": ["build"], "set": {"WERKS": "bad"}},
        {"when": ["*", r"_2"], "set": {"WERKS": "1200", "_kind": "far"}},
        {"when": ["house", "*"], "set": {"WERKS": "1300", "_kind": ""}},
    ],
    "on_no_match": {"action": "default", "values": {"WERKS": "1000"}},
}


def customer_headers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    nation = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("n_name"))
    return c.withColumn("header", F.struct(value(F.col("c_mktsegment")).alias("segment"), value(nation).alias("nation"), value(F.col("c_name")).alias("name")))


_SRC = "upper(trim(CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE n_name END))"


@query(f"""SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'machin') AND regexp_matches({_SRC}, '^NATION_1\\d?$') THEN '1100'
WHEN regexp_matches({_SRC}, '_2') THEN '1200' WHEN contains(lower(c_mktsegment), 'house') THEN '1300' ELSE '1000' END AS werks,
CASE WHEN contains(lower(c_mktsegment), 'machin') AND regexp_matches({_SRC}, '^NATION_1\\d?$') THEN 'heavy'
WHEN regexp_matches({_SRC}, '_2') THEN 'far' ELSE '' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_decision_table(spark, sf_dir):
    """First matching row of a decision table, with fallback source, normalizers, a skipped row and defaults."""
    c = customer_headers(spark, sf_dir)
    values, _ = rules.decision_table(DECISION, engine.Scope({}, c))
    return c.withColumn("t", values).select("c_custkey", F.col("t.WERKS").alias("werks"), F.col("t._kind").alias("kind"))


@query("""SELECT p_partkey, contains(lower(p_name), 'ring') AS contains_ci, p_brand = 'Brand#2' AS equals, lower(p_type) = 'promo' AS equals_ci,
starts_with(p_name, 'sm') AS starts_with, regexp_matches(p_brand, '#\\d$') AS regex FROM part""")
def q_ops_all(spark, sf_dir):
    """The five comparisons."""
    tests = {"contains_ci": ("p_name", "RING"), "equals": ("p_brand", "Brand#2"), "equals_ci": ("p_type", "Promo"), "starts_with": ("p_name", "sm"), "regex": ("p_brand", r"#\d\Z")}
    return table(spark, sf_dir, "part").select("p_partkey", *[OPS[op](F.col(c), n).alias(op) for op, (c, n) in tests.items()])


def _part(spark, sf_dir) -> tuple[DataFrame, engine.Scope]:
    p = table(spark, sf_dir, "part")
    p = p.withColumn("line", F.struct(value(F.col("p_name")).alias("description"), value(F.col("p_brand")).alias("brand_text"), value(F.col("p_type")).alias("item_code"), value(F.col("p_retailprice")).alias("unit_price")))
    return p, engine.Scope({"customer_no": "BIG"}, p)


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'R' WHEN contains(lower(p_name), 'red') THEN 'D' WHEN contains(lower(p_name), 'w') THEN 'W' ELSE '' END AS code,
CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') OR contains(lower(p_name), 'w') THEN NULL ELSE 'warn' END AS level FROM part""")
def q_keyword_map(spark, sf_dir):
    """keyword_map with a warning on a miss."""
    p, scope = _part(spark, sf_dir)
    rule = {"source": "line.description", "case": "insensitive", "map": [{"contains": "RING", "value": "R"}, {"contains": "red", "value": "D"}, {"contains": "w", "value": "W"}]}
    code, level = rules.on_miss(rules.keyword_map(rule, scope), rule)
    return p.select("p_partkey", code.alias("code"), level.alias("level"))


@query("""SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'MACHINERY' THEN 'M' WHEN 'BUILDING' THEN 'B' ELSE 'X' END AS code FROM customer""")
def q_value_map(spark, sf_dir):
    """value_map with a default."""
    c = customer_headers(spark, sf_dir)
    rule = {"source": "header.segment", "normalize": ["trim"], "map": [{"equals": "MACHINERY", "value": "M"}, {"equals": "BUILDING", "value": "B"}, {"equals": "MACHINERY", "value": "Z"}], "on_no_match": {"action": "default", "value": "X"}}
    return c.select("c_custkey", rules.on_miss(rules.value_map(rule, engine.Scope({}, c)), rule)[0].alias("code"))


NEEDLES = [("r", "1"), ("ring", "2"), ("  ", "3"), ("red ring", "4"), ("big", "5"), ("red", "6")]
_NEEDLES_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', '{v}')" for i, (n, v) in enumerate(NEEDLES)) + ") AS m(ord, needle, v)"


def _csv_map_sql(order: str) -> str:
    return f"""SELECT p_partkey, v FROM (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY {order}) AS rn
FROM part LEFT JOIN {_NEEDLES_SQL} ON trim(needle) <> '' AND contains(lower(p_name), needle)) WHERE rn = 1"""


@query(_csv_map_sql("ord"))
def q_csv_map_order(spark, sf_dir):
    """csv_map in file order."""
    return rules.csv_map(table(spark, sf_dir, "part"), NEEDLES, F.col("p_name"), "v").select("p_partkey", "v")


@query(_csv_map_sql("length(needle) DESC, ord"))
def q_csv_map_longest(spark, sf_dir):
    """csv_map, longest needle first."""
    return rules.csv_map(table(spark, sf_dir, "part"), NEEDLES, F.col("p_name"), "v", longest_first=True).select("p_partkey", "v")


@query("""WITH b AS (SELECT n_regionkey AS k, CASE WHEN n_nationkey % 5 < 2 THEN n_name WHEN n_nationkey % 5 = 2 THEN '' ELSE 'SAME' END AS v FROM nation WHERE n_regionkey <> 0 OR n_nationkey = 0),
c AS (SELECT k, count(DISTINCT v) AS n, min(v) AS v FROM b WHERE v <> '' GROUP BY k)
SELECT n_nationkey, CASE WHEN coalesce(n, 0) = 1 THEN c.v ELSE '' END AS choice, coalesce(n, 0) AS choices FROM nation LEFT JOIN c ON n_regionkey = k""")
def q_csv_choice(spark, sf_dir):
    """csv_choice: a key's only value, and how many it has."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    ref = n.filter("n_regionkey <> 0 OR n_nationkey = 0").select(F.col("n_regionkey").alias("k"), F.when(k < 2, F.col("n_name")).when(k == 2, "").otherwise("SAME").alias("v"), F.col("n_nationkey").alias("_ord"))
    return rules.csv_choice(n, ref, F.col("n_regionkey"), "k", "v", "choice").select("n_nationkey", "choice", F.col("choice_count").alias("choices"))


@query("""WITH ref AS (SELECT p_name AS k, p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)
SELECT s_suppkey, coalesce(p_brand, '') AS brand, coalesce(p_type, '') AS kind FROM supplier
LEFT JOIN ref ON rn = 1 AND k = CASE s_suppkey % 4 WHEN 0 THEN 'red widget' WHEN 1 THEN 'small ring' WHEN 2 THEN '' ELSE 'Red Widget' END""")
def q_lookup(spark, sf_dir):
    """lookup: the first reference row of an exact key; blanks on a miss."""
    s = table(spark, sf_dir, "supplier")
    m = F.col("s_suppkey") % 4
    key = F.when(m == 0, "red widget").when(m == 1, "small ring").when(m == 2, "").otherwise("Red Widget")
    ref = table(spark, sf_dir, "part").withColumn("_ord", F.col("p_partkey"))
    return rules.lookup(s, ref, key, "p_name", ["p_brand", "p_type"], "hit").select("s_suppkey", F.col("hit.p_brand").alias("brand"), F.col("hit.p_type").alias("kind"))


@query("""SELECT o_orderkey, regexp_extract(o_orderpriority, '(\\d)-(\\w+)', 2) AS word, CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN NULL ELSE 'error' END AS level FROM orders""")
def q_regex_extract(spark, sf_dir):
    """regex_extract by group name, and its miss."""
    o = table(spark, sf_dir, "orders").withColumn("header", F.struct(value(F.col("o_orderpriority")).alias("order_text")))
    scope = engine.Scope({}, o)
    word = rules.regex_extract({"source": "header.order_text", "pattern": r"(?P<n>\d)-(?P<word>\w+)", "group": "word"}, scope)
    high = {"source": "header.order_text", "pattern": "^([12])-", "on_no_match": {"action": "error"}}
    return o.select("o_orderkey", word.alias("word"), rules.on_miss(rules.regex_extract(high, scope), high)[1].alias("level"))


def _evaluated(spark, sf_dir, **sources) -> DataFrame:
    p, scope = _part(spark, sf_dir)
    compiled = {name: compile_expr(source, scope) for name, source in sources.items()}
    return p.select("p_partkey", *[F.when(v.error.isNull(), as_text(v)).otherwise("ERROR").alias(n) for n, v in compiled.items()])


@query("""SELECT p_partkey, p_brand || '/' || p_name AS joined, replace(p_name, 'r', 'RR') AS swapped, substring(p_name, 3, 4) AS middle,
CASE WHEN length(p_type) < 8 THEN lpad(p_type, 8, '*') ELSE p_type END AS padded, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trimmed,
CASE WHEN length(p_name) <= 2 THEN '' ELSE right(p_name, 2) END AS ending FROM part""")
def q_expr_text(spark, sf_dir):
    """Text functions of the expression language."""
    return _evaluated(
        spark, sf_dir, joined="concat(line.brand_text, '/', line.description, null)", swapped="replace(line.description, 'r', 'RR')", middle="substr(line.description, 2, 4)",
        padded="pad(line.item_code, 8, '*')", up="upper(line.description)", low="lower(line.brand_text)", trimmed="trim(concat('  ', line.description, ' '))", ending="substr(line.description, -2, 99)",
    )


@query("""SELECT p_partkey, p_type || '-' || '' || '-' || p_brand AS kept, p_type || '-' || p_brand AS compacted,
CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'true' ELSE '' END AS known FROM part""")
def q_expr_list(spark, sf_dir):
    """List functions of the expression language."""
    return _evaluated(spark, sf_dir, kept="join('-', [line.item_code, null, line.brand_text])", compacted="join('-', compact([line.item_code, '', null, line.nothing, line.brand_text]))", known="in(line.item_code, ['PROMO', 'LARGE'])")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN p_brand ELSE '' END AS lazy, CASE WHEN contains(p_name, 'red') THEN p_brand ELSE 'ERROR' END AS failing,
p_type AS first, CASE WHEN contains(p_name, 'RED') THEN 'true' ELSE '' END AS cased FROM part""")
def q_expr_logic(spark, sf_dir):
    """Logic: only the branch that is taken can fail."""
    return _evaluated(spark, sf_dir, lazy="if(contains(line.description, 'red'), line.brand_text, null)", failing="if(contains(line.description, 'red'), line.brand_text, integer('x'))", first="coalesce('', null, line.nothing, line.item_code)", cased="contains(line.description, 'RED')")


def _formatted(texts: DataFrame, name: str) -> DataFrame:
    """The distinct texts (t) in a format, whether it failed, and how often they stand there."""
    value_, failed = apply_format(name, F.col("t"))
    return texts.groupBy("t").agg(F.count("*").alias("times")).select("t", value_.alias("v"), failed.alias("failed"), "times")


# Quantities as they are written: with decimals, thousands, white space, fractions, letters, blank, negative.
_QUANTITY = """CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN concat(q, '.000') WHEN 1 THEN concat('1,', lpad(q, 3, '0')) WHEN 2 THEN concat(' ', q, ' 0 ') WHEN 3 THEN concat(q, '.5')
WHEN 4 THEN concat('x', q) WHEN 5 THEN '' WHEN 6 THEN concat('-', q, '.', lpad(CAST(l_partkey % 10000 AS VARCHAR(9)), 4, '0')) ELSE concat(q, '.', lpad(CAST(l_suppkey % 100 * 100 + 5 AS VARCHAR(9)), 4, '0'), '5') END"""
_QUANTITY_SQL = f"(SELECT {_QUANTITY} AS t FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem))"
_CLEAN = "TRY_CAST(regexp_replace(t, '[,\\s]', '', 'g') AS DECIMAL(38,18))"


def _quantities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string")).select(F.expr(_QUANTITY).cast("string").alias("t"))


@query(f"""SELECT t, CASE WHEN t = '' OR {_CLEAN} IS NULL OR {_CLEAN} <> floor({_CLEAN}) THEN t ELSE CAST(CAST(floor({_CLEAN}) AS DECIMAL(38,0)) AS VARCHAR) END AS v,
t <> '' AND ({_CLEAN} IS NULL OR {_CLEAN} <> floor({_CLEAN})) AS failed, count(*) AS times FROM {_QUANTITY_SQL} GROUP BY t""")
def q_format_integer(spark, sf_dir):
    """The integer format over written quantities: separators go, fractions fail."""
    return _formatted(_quantities(spark, sf_dir), "integer")


@query(f"""SELECT t, CASE WHEN t = '' OR {_CLEAN} IS NULL THEN t ELSE CAST(CAST(round_even({_CLEAN}, 3) AS DECIMAL(38,3)) AS VARCHAR) END AS v, t <> '' AND {_CLEAN} IS NULL AS failed, count(*) AS times FROM {_QUANTITY_SQL} GROUP BY t""")
def q_format_decimal3(spark, sf_dir):
    """The decimal3 format over written quantities: half to even."""
    return _formatted(_quantities(spark, sf_dir), "decimal3")


# Order dates as they are written: ISO, dots without zeros, US, European, packed, out of range, by name, blank.
_DATE = """CASE o_orderkey % 8 WHEN 0 THEN concat(y, '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0')) WHEN 1 THEN concat(' ', y, '.', m, '.', d, ' ') WHEN 2 THEN concat(m, '/', d, '/', substring(y, 3, 2)) WHEN 3 THEN concat(d, '/', m, '/', y)
WHEN 4 THEN concat(y, lpad(m, 2, '0'), lpad(d, 2, '0')) WHEN 5 THEN concat(y, '/', m, '/', CAST(CAST(d AS INTEGER) + 9 AS VARCHAR(9))) WHEN 6 THEN concat('May ', d) ELSE '' END"""
_DATE_SQL = f"(SELECT {_DATE} AS t FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(day(o_orderdate) AS VARCHAR) AS d FROM orders))"


@query(f"""WITH p AS (SELECT t, trim(t) AS r, count(*) AS times FROM {_DATE_SQL} GROUP BY t),
g AS (SELECT t, times, CASE WHEN regexp_matches(r, '^\\d{{4}}[-./]\\d{{1,2}}[-./]\\d{{1,2}}$') THEN regexp_extract_all(r, '\\d+')
WHEN regexp_matches(r, '^\\d{{8}}$') THEN [substring(r, 1, 4), substring(r, 5, 2), substring(r, 7, 2)]
WHEN regexp_matches(r, '^\\d{{1,2}}[-./]\\d{{1,2}}[-./](\\d{{2}}|\\d{{4}})$') THEN (SELECT CASE WHEN CAST(x[1] AS INT) <= 12 THEN [y, x[1], x[2]] ELSE [y, x[2], x[1]] END
 FROM (SELECT regexp_extract_all(r, '\\d+') AS x, CASE WHEN length(regexp_extract_all(r, '\\d+')[3]) = 2 THEN '20' || regexp_extract_all(r, '\\d+')[3] ELSE regexp_extract_all(r, '\\d+')[3] END AS y)) END AS d FROM p)
SELECT t, CASE WHEN ok THEN d[1] || lpad(d[2], 2, '0') || lpad(d[3], 2, '0') ELSE t END AS v, t <> '' AND NOT ok AS failed, times
FROM (SELECT *, coalesce(CAST(d[2] AS INT) BETWEEN 1 AND 12 AND CAST(d[3] AS INT) BETWEEN 1 AND 31, false) AS ok FROM g)""")
def q_format_date(spark, sf_dir):
    """The date format over written order dates: ranges are checked, calendars are not."""
    part = lambda f: f("o_orderdate").cast("string")
    dates = table(spark, sf_dir, "orders").select("o_orderkey", part(F.year).alias("y"), part(F.month).alias("m"), part(F.dayofmonth).alias("d"))
    return _formatted(dates.select(F.expr(_DATE).cast("string").alias("t")), "date_yyyymmdd")


@query("""SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_type || ')x（' || p_brand || '）', '\\s*[(（][^()（）]*[)）]', '', 'g')) AS v FROM part""")
def q_strip_parens(spark, sf_dir):
    """The strip_parens format, half and full width."""
    text = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")x（"), "p_brand", F.lit("）"))
    return table(spark, sf_dir, "part").select("p_partkey", apply_format("strip_parens", text)[0].alias("v"))


@query("""SELECT p_partkey, regexp_replace(trim(p_name || '  ' || p_type), '\\s+', ' ', 'g') AS collapsed, replace(lower(p_type || 'ß'), 'ß', 'ss') AS folded FROM part""")
def q_normalizers(spark, sf_dir):
    """White space and case folding."""
    return table(spark, sf_dir, "part").select("p_partkey", strip(collapse_spaces(F.concat("p_name", F.lit(" \t "), "p_type"))).alias("collapsed"), casefold(F.concat("p_type", F.lit("ß"))).alias("folded"))


# The flagship rule book: orders, their customers' segments and parts become rows of ten fields.
BOOK = {
    "meta": {"code": "ORD", "customer_no": "100"},
    "base": {"AUART": "ZOR"},
    "tables": [
        {
            "name": "routing",
            "columns": [{"source": "header.order_text", "op": "starts_with"}, {"source": "line.description", "op": "contains_ci"}],
            "rows": [{"when": ["1", "*"], "set": {"VSART": "AIR", "_fast": "yes"}}, {"when": ["*", "ring"], "set": {"VSART": "POST", "_fast": ""}}],
            "on_no_match": {"action": "warn", "message": "no route for {description}"},
        }
    ],
    "rules": {
        "brand_no": {"kind": "regex_extract", "source": "line.brand_text", "pattern": r"#(\d+)$", "group": 1, "field": "ZBRAND"},
        "size": {"kind": "keyword_map", "source": "line.description", "map": [{"contains": "small", "value": "S"}, {"contains": "big", "value": "L"}], "on_no_match": {"action": "default", "value": "M"}},
    },
    "fields": {
        "AUART": {"from": "base"},
        "BSTKD": {"from": "doc", "path": "header.po_number", "format": "integer"},
        "POSEX": {"from": "gen", "gen": "line_no_x10"},
        "MATNR": {"from": "expr", "expr": "concat(upper(substr(line.description, 0, 3)), '-', pad(line.item_code, 6, '0'))"},
        "KWMENG": {"from": "doc", "path": "line.quantity", "format": "decimal3"},
        "ZBRAND": {"from": "rule", "rule": "brand_no"},
        "ZSIZE": {"from": "rule", "rule": "size"},
        "VSART": {"from": "table", "fallback": "header.remark_default", "default": "SEA"},
        "BSTDK": {"from": "doc", "path": "header.po_date", "format": "date_yyyymmdd"},
        "ZTEXT": {"from": "expr", "expr": "join('/', compact([field.ZSIZE, field.VSART]))"},
    },
    "field_specs": {
        "AUART": {"required": True}, "BSTKD": {"required": True, "max_len": 8}, "POSEX": {}, "MATNR": {"max_len": 10}, "KWMENG": {"nonzero": True},
        "ZBRAND": {"max_len": 1}, "ZSIZE": {}, "VSART": {"required": "warn"}, "BSTDK": {}, "ZTEXT": {},
    },
    "own_fields": ["ZBRAND"],
}


def order_items(spark, sf_dir) -> DataFrame:
    """Rows after SPLIT, from orders, lineitem and part: lines of one supplier in an order are one shipment."""
    # Parts first: all later steps go by order, on one shuffle.
    with_parts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    joined = order_lines(spark, sf_dir, with_parts).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    header = F.struct(value(F.col("o_orderkey")).alias("po_number"), value(F.date_format("o_orderdate", "M/d/yy")).alias("po_date"), value(F.col("o_orderpriority")).alias("order_text"), value(F.when(F.col("o_orderstatus") == "O", "RAIL").otherwise("")).alias("remark_default"))
    line = F.struct(value(F.col("p_name")).alias("description"), value(F.col("p_brand")).alias("brand_text"), value(F.col("l_partkey")).alias("item_code"), value(F.format_number("l_quantity", 1)).alias("quantity"))
    return joined.select(F.col("l_orderkey").alias("doc_id"), "ship_idx", "line_no", F.lit(True).alias("split"), F.struct(F.lit(None).cast("string").alias("total_qty")).alias("totals"), header.alias("header"), F.struct(value(F.col("l_suppkey")).alias("shipment_no")).alias("shipment"), line.alias("line"))


_FIELDS_SQL = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {TIE_SQL}) AS line_no,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, {TIE_SQL}) AS n FROM lineitem),
f AS (SELECT l_orderkey AS doc_id, printf('r_%04d', n) AS row_id, CAST(l_suppkey AS VARCHAR) AS grp, 'ZOR' AS auart, CAST(o_orderkey AS VARCHAR) AS bstkd,
lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') AS posex, upper(substring(p_name, 1, 3)) || '-' || CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 6 THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') ELSE CAST(l_partkey AS VARCHAR) END AS matnr,
CAST(CAST(l_quantity AS DECIMAL(18,3)) AS VARCHAR) AS kwmeng, regexp_extract(p_brand, '#(\\d+)$', 1) AS zbrand,
CASE WHEN contains(p_name, 'small') THEN 'S' WHEN contains(p_name, 'big') THEN 'L' ELSE 'M' END AS zsize,
CASE WHEN starts_with(o_orderpriority, '1') THEN 'AIR' WHEN contains(p_name, 'ring') THEN 'POST' WHEN o_orderstatus = 'O' THEN 'RAIL' ELSE 'SEA' END AS vsart,
NOT (starts_with(o_orderpriority, '1') OR contains(p_name, 'ring')) AS missed, '20' || strftime(o_orderdate, '%y%m%d') AS bstdk
FROM l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query(_FIELDS_SQL + """ SELECT doc_id, row_id, grp, auart, bstkd, posex, matnr, kwmeng, zbrand, zsize, vsart, bstdk, zsize || '/' || vsart AS ztext,
concat_ws(',', CASE WHEN missed THEN 'TABLE_NO_MATCH' END, CASE WHEN length(matnr) > 10 THEN 'TOO_LONG' END, CASE WHEN length(zbrand) > 1 THEN 'TOO_LONG' END) AS issues FROM f""")
def q_fields_render(spark, sf_dir):
    """The whole row engine over orders: tables, rules, fields, derived fields, validation."""
    built = engine.build_rows(order_items(spark, sf_dir), BOOK)
    codes = F.array_join("issues.code", ",")
    return built.select("doc_id", "row_id", F.col("group").alias("grp"), *[F.col(c).alias(c.lower()) for c in BOOK["field_specs"]], codes.alias("issues"))


@query(_FIELDS_SQL + """ SELECT doc_id, row_id, zsize || '+' || kwmeng AS za, upper(zsize || '+' || kwmeng) || '!' AS zb FROM f""")
def q_derived_fields(spark, sf_dir):
    """Fields computed from other fields, in field order."""
    keep = ("KWMENG", "ZSIZE")
    book = BOOK | {"tables": [], "own_fields": [], "fields": {k: BOOK["fields"][k] for k in keep} | {"ZA": {"from": "expr", "expr": "concat(field.ZSIZE, '+', field.KWMENG)"}, "ZB": {"from": "expr", "expr": "concat(upper(field.ZA), '!')"}}, "field_specs": {k: {} for k in (*keep, "ZA", "ZB")}}
    return engine.build_rows(order_items(spark, sf_dir), book).select("doc_id", "row_id", F.col("ZA").alias("za"), F.col("ZB").alias("zb"))


def _validated(spark, sf_dir, specs: dict) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", flag.alias("A"), F.when(F.col("l_linestatus") == "O", "").otherwise("x").alias("B"), F.format_number("l_discount", 2).alias("C"))
    found = F.filter(F.array(*engine.row_validation(specs)), lambda x: x["code"].isNotNull())
    text = F.array_join(F.transform(found, lambda x: F.concat(x["field"], F.lit(":"), x["severity"])), ",")
    return lines.withColumn("issues", text).groupBy("issues").agg(F.count("*").alias("n"))


@query("""SELECT concat_ws(',', CASE WHEN l_returnflag = 'N' THEN 'A:error' END, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'B:warn' END) AS issues, count(*) AS n FROM lineitem GROUP BY 1""")
def q_required(spark, sf_dir):
    """Required fields, and required unless another is filled."""
    return _validated(spark, sf_dir, {"A": {"required": True}, "B": {"required": "warn", "required_unless": ["A"]}})


@query("""SELECT CASE WHEN l_discount = 0 THEN 'C:error' ELSE '' END AS issues, count(*) AS n FROM lineitem GROUP BY 1""")
def q_nonzero(spark, sf_dir):
    """Numbers that mustn't be zero."""
    return _validated(spark, sf_dir, {"C": {"nonzero": True}})


@query("""SELECT p_partkey, length(p_name) > 9 AS too_long, length(p_name) AS n FROM part""")
def q_max_len(spark, sf_dir):
    """Lengths in code points."""
    p = table(spark, sf_dir, "part").withColumn("NAME", F.col("p_name"))
    return p.select("p_partkey", F.array(*engine.row_validation({"NAME": {"max_len": 9}}))[0]["code"].isNotNull().alias("too_long"), F.length("p_name").cast("long").alias("n"))


@query("""SELECT l_orderkey AS doc_id, count(*) AS n, max(CASE WHEN total <> printed AND l_orderkey % 3 <> 0 THEN 1 ELSE 0 END) AS mismatch
FROM (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, CASE WHEN l_orderkey % 2 = 0 THEN sum(l_quantity) OVER (PARTITION BY l_orderkey) ELSE 7 END AS printed FROM lineitem) GROUP BY 1""")
def q_shipment_total_match(spark, sf_dir):
    """Printed totals of split documents against the sum of their rows."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").alias("s"))
    r = lines.select(F.col("l_orderkey").alias("doc_id"), F.format_number("l_quantity", 1).alias("KWMENG"), F.array().cast(f"array<{engine.ISSUE}>").alias("issues")).join(sums, "doc_id")
    printed = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 2 == 0, F.format_number("s", 2)).otherwise("7")
    checked = engine.shipment_total_match(r.withColumn("split", F.lit(True)).withColumn("totals", F.struct(printed.alias("total_qty"))), {})
    return checked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.size("issues") > 0).cast("int")).alias("mismatch"))


@query("""SELECT l_orderkey AS doc_id, sum(CASE WHEN l_returnflag = 'R' AND 2 * e < n THEN 1 ELSE 0 END) AS missed FROM (SELECT l_orderkey, l_returnflag,
count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS e FROM lineitem) GROUP BY 1""")
def q_likely_missed(spark, sf_dir):
    """Blank cells of fields that most rows of a document fill."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("FLAG"), F.array().cast(f"array<{engine.ISSUE}>").alias("issues"))
    return engine.likely_missed(r, ["FLAG"]).groupBy("doc_id").agg(F.sum(F.size("issues").cast("long")).alias("missed"))
