"""Fields are rendered in steps that are computed once, with the results of the formats in one expression."""

import re

from pyspark.sql import functions as F

from millrace.functions.formats import FORMATS, add_formats, apply_format
from millrace.functions.text import strip, strip_column
from millrace.plans import rule_queries

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "1,250", "25.000", "2.5", "x", "-3", "1e3", "2024-1-2", "20240102", "2024010x", "13/2/24", "2/13/2024", "2/31/99", "0/1/24", " 7.8.24\u3000", "(a) b", "99999999999999999999999999", None]


def test_steps_give_what_formats_give(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for name in FORMATS:
        got = add_formats(rows, {"t": name})
        want = apply_format(name, F.col("t"))
        assert all(r[0] == (r[1], r[2]) for r in got.select("_f_t", *want).collect()), name


def test_strip_column(spark):
    texts = ["", " ", "a", " a", "a ", "\u3000a", "a\x1c", "\x7fa\x7f", "é ", " é", "a b", "\ta\n", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(r[0] == r[1] for r in rows.select(strip_column(F.col("t")), strip(F.col("t"))).collect())


def test_plan_of_rendered_orders(spark):
    """Numbers are read once a field, issues are gathered without lambdas, lines are shuffled by part and by order once, and stages whose code isn't compiled aren't fused."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = rule_queries.q_fields_render(spark, SF)._jdf.queryExecution()
        plan, physical = query.optimizedPlan().toString(), query.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("regexp_replace(") == 2
    assert "exists(" not in plan and plan.count("filter(") <= 1
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 4
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
