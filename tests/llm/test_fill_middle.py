"""Fill-in-the-middle against a plain version, on the smallest documents and on awkward rows."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from millrace.llm import fill_middle, registry

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, ""), (2, None), (3, "one"), (4, "<"), (5, "a <P> b"), (6, "x <S>"), (7, "<M>"), (8, "< P> <S <M <P"), (9, "été 日本 \U0001f600 ab1c\n\r\n\x00z"), (9, "second of nine, one two"),
    (None, "no id at all"), (-5, "minus five"), (10, "w " * 60_000), (11, "!" * 5000), (2**62, "large id"), *((i, f"text {i} <P") for i in range(20, 120)),
]


def plain(doc_id, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, text
    return (len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def key(rows):
    return sorted(rows, key=repr)


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, n string, output int").repartition(3)
    out = fill_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == key((i, *plain(i, t)) for i, t in ROWS)
    assert key((r.doc_id, r.back) for r in got) == key((i, t or "") for i, t in ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)


def test_small_pieces_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch({"id": ["1", "2", "3", "4"], "text": ["abc", "", "d" * 50, "e"]})
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 4)
    assert [p.column(0).to_pylist() for p in fill_middle.pieces(batch)] == [["1", "2"], ["3"], ["4"]]


def test_empty_table(spark):
    out = fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id int, text string"))
    assert out.count() == 0 and out.schema["doc_id"].dataType.simpleString() == "int"


def test_query(spark):
    got = registry.op11_fill_in_middle(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, *plain(i, t)[:2], sha(plain(i, t)[4]), sha(t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True))
    assert sorted(zip(got.doc_id, got.n, got.form, got.output_sha256, got.restored_sha256, strict=True)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(registry.ORACLES["op11_fill_in_middle"]).df()
    assert sorted(sql.columns) == sorted(got.columns)
    side = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    as_int = lambda df: df.assign(prefix_chars=df.prefix_chars.astype("Int64"), middle_chars=df.middle_chars.astype("Int64"), n=df.n.astype("Int64"))
    assert side(as_int(got)) == side(as_int(sql))
