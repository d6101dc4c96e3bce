"""Pre-check of documents against the hints of their customers' rule books: which quoted labels stand in a document, before anything is paid for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, collapse_spaces, strip

# Quoted labels, the value at a label's end, lines of examples, and the shortest label.
QUOTED = r'"([^"\n]{3,80})"'
TRAILING = r"(?U)[\s:：]*[-\d.,/]+\s*\z"
EXAMPLES = r"(?U)\A\s*(예시?|e\.?g\.?|ex)\s*[:)：]"
SHORTEST = 3


def comparable(c: Column) -> Column:
    return casefold(strip(collapse_spaces(c)))


def hint_phrases(books: DataFrame) -> DataFrame:
    """(customer, phrases): the quoted phrases of each book's hints in order, once each, with whether they are examples, and the label that is left
    without the value at its end ('' if it is too short). books: customer, hints (null: none)."""
    lines = F.split(F.coalesce("hints", F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    quoted = lambda line: F.transform(F.regexp_extract_all(line, F.lit(QUOTED), F.lit(1)), lambda t: F.named_struct(F.lit("text"), strip(t), F.lit("example"), line.rlike(EXAMPLES)))
    found = books.select("customer", F.filter(F.flatten(F.transform(lines, quoted)), lambda p: p["text"] != "").alias("_p"))
    first = F.filter("_p", lambda p, i: ~F.exists(F.slice("_p", F.lit(1), i), lambda q: q["text"] == p["text"]))
    label = lambda t: F.regexp_replace(F.regexp_replace(t, TRAILING, ""), "^[ :：]+|[ :：]+$", "")
    short = lambda t: F.when(F.length(label(t)) >= SHORTEST, comparable(label(t))).otherwise("")
    phrases = F.transform(first, lambda p: F.named_struct(F.lit("text"), p["text"], F.lit("example"), p["example"], F.lit("whole"), comparable(p["text"]), F.lit("label"), short(p["text"])))
    return found.select("customer", phrases.alias("phrases"))


def check_hints(documents: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, verdict, found, partial, missing, examples): labels that stand in the document, that stand there without their value, and that don't,
    and the examples that stand there.

    documents: doc_id, customer, text, has_text. verdict: scan (nothing to compare), no_hints, none_found, some_missing, ready. Phrases are those of one rule book, so that they
    come as one array a document; a document is read once for all of them, and not copied.
    """
    rows = documents.join(hint_phrases(books).select(F.col("customer").alias("_c"), "phrases"), F.col("customer") == F.col("_c"), "left").withColumn("_text", comparable(F.coalesce("text", F.lit(""))))
    there = lambda p: F.contains("_text", p["whole"])
    short = lambda p: (p["label"] != "") & F.contains("_text", p["label"])
    state = F.transform("phrases", lambda p: F.named_struct(F.lit("text"), p["text"], F.lit("state"), F.when(p["example"], F.when(there(p), "example").otherwise("")).when(there(p), "found").when(short(p), "partial").otherwise("missing")))
    rows = rows.withColumn("_state", F.when(F.col("has_text"), state))
    of = lambda kind: F.coalesce(F.transform(F.filter("_state", lambda x: x["state"] == kind), lambda x: x["text"]), F.array().cast("array<string>"))
    rows = rows.select("doc_id", "has_text", F.coalesce(F.size("phrases"), F.lit(0)).alias("_n"), of("found").alias("found"), of("partial").alias("partial"), of("missing").alias("missing"), of("example").alias("examples"))
    hit = F.size("found") + F.size("partial")
    verdict = F.when(~F.coalesce("has_text", F.lit(False)), "scan").when(F.col("_n") == 0, "no_hints").when(hit == 0, "none_found").when(F.size("missing") > 0, "some_missing").otherwise("ready")
    return rows.select("doc_id", verdict.alias("verdict"), "found", "partial", "missing", "examples")
