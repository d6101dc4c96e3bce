"""Grounding: whether extracted values stand on the lines that they point at, as one operator over all values of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from .anchors import anchor_normalized, confidence_issue, normalized, part_unknown
from .documents import slice_text


def ground(values: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, path, level, code) of the issues of values.

    values: doc_id, path, value, src, src_end (null: src), confidence, the booleans required and part (a part number), and lo, hi, the lines
    that a chunk may point at (null: all). documents: doc_id, lines (an array), has_text, anchored. Without a text layer, or if no anchors
    were asked for, confidence alone is judged. An error replaces the warning of the same value. Blank values have no issues.
    """
    whole = [c for c in values.columns if c != "doc_id"]
    kept = values.filter(~blank(strip(F.col("value")))).withColumns({"_end": F.coalesce("src_end", "src"), "_needle": normalized(F.col("value"))})
    text = documents.select("doc_id", "lines", F.coalesce(F.col("has_text") & F.col("anchored"), F.lit(False)).alias("_check"))
    # One row a document: its lines are read where they are, and not copied to each value.
    joined = kept.groupBy("doc_id").agg(F.collect_list(F.struct(*whole, "_end", "_needle")).alias("_values")).join(text, "doc_id").withColumn("_text", normalized(F.array_join("lines", "\n")))
    # Where anchors aren't judged, no text is looked at.
    unknown = lambda v: F.col("_check") & v["part"] & part_unknown(v["_needle"], F.col("_text"))
    hay = lambda v: F.when(F.col("_check"), slice_text(F.col("lines"), v["src"], v["_end"]))
    judged = F.transform("_values", lambda v: F.struct(v.alias("v"), hay(v).alias("_hay"), unknown(v).alias("_unknown")))
    rows = joined.select("doc_id", "_check", F.size("lines").alias("_size"), F.explode_outer(judged).alias("_j")).select("doc_id", "_check", "_size", "_j.v.*", "_j._hay", "_j._unknown")
    rows = rows.withColumn("_hay", normalized(F.col("_hay")))
    rows = rows.withColumn("_found", F.when(F.col("_check"), anchor_normalized(F.col("_needle"), F.col("_hay"))))
    within = (F.col("src") >= 1) & (F.col("src") <= F.col("_end")) & (F.col("_end") <= F.col("_size"))
    astray = F.col("lo").isNotNull() & ((F.col("src") < F.col("lo")) | (F.col("_end") > F.col("hi")))
    wrong = ~F.coalesce(within, F.lit(False)) | F.coalesce(astray, F.lit(False)) | (F.col("_found") == "miss") | F.coalesce("_unknown", F.lit(False))
    told = lambda level, code: F.struct(level.alias("level"), F.lit(code).alias("code"))
    evidence = F.when(F.col("_check") & wrong, told(F.lit("error"), "EVIDENCE_NOT_FOUND")).when(F.col("_check") & (F.col("_found") == "fuzzy"), told(F.lit("warn"), "EVIDENCE_WEAK"))
    level = confidence_issue(F.col("confidence"), F.coalesce("required", F.lit(False)))
    issues = F.array(evidence, F.when(level.isNotNull(), told(level, "LOW_CONFIDENCE")))
    # Those that are null go as rows: a filter by a lambda would be interpreted for each value. Not explode: the filter that is inferred of it would look at every value a second time.
    return rows.select("doc_id", "path", F.explode_outer(issues).alias("_i")).filter("_i IS NOT NULL").select("doc_id", "path", "_i.level", "_i.code")
