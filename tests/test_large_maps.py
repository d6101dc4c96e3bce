"""Maps by large reference tables: needles of all lengths, and no join whose side is gathered by the driver."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules


@pytest.mark.parametrize("few", [3, 50])
def test_long_needles_without_broadcasts(spark, monkeypatch, tmp_path, few):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab1 日") for _ in range(n))
    texts = [word(draw.randrange(0, 60)) for _ in range(80)]
    cuts = [t[i : i + n] for t in texts for n in (1, 2, 5, 8, 12, 16, 20, 40) for i in [draw.randrange(0, 20)]]
    needles = [(i, n, draw.choice(["contains", "equals"])) for i, n in enumerate([*cuts, *texts[:9]]) if n] * 2
    monkeypatch.setattr(rules, "FEW_ENTRIES", few)
    entry = F.struct((-F.length("n")).alias("r"), F.col("o").cast("long").alias("o"), F.col("n"), (F.col("m") == "equals").alias("w"), F.col("n").alias("v"))
    spark.createDataFrame(needles, "o int, n string, m string").write.parquet(f"{tmp_path}/needles")
    entries = spark.read.parquet(f"{tmp_path}/needles").select(entry.alias("e"))
    spark.createDataFrame([(t,) for t in sorted(set(texts))], "_one_src string").write.parquet(f"{tmp_path}/sources")
    sources = spark.read.parquet(f"{tmp_path}/sources").withColumn("_hay", F.col("_one_src"))
    found = rules.first_contained(sources, entries)
    hit = lambda t, n, m: n == t if m == "equals" else n in t
    want = {t: min(((-len(n), o) for o, n, m in needles if hit(t, n, m)), default=None) for t in texts}
    assert {r._one_src: (r._best.r, r._best.o) for r in found.collect()} == {t: w for t, w in want.items() if w}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
