"""Edits of review rows as a whole: values, what follows from them, and what is still wrong."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.text import blank
from . import engine, review


def apply_edits(rows: DataFrame, edits: DataFrame, book: Mapping, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows with edits applied, and the edits of unknown rows.

    rows: key, the book's fields with `<field>_original`, deleted, manual, issues. Of rows that an edit names, fields that read others are
    computed again unless a person changed them (`manual`), `edited` lists what differs from the original, and issues are judged anew: what
    is carried (review.carried_issues), then row validation, without repeats; deleted rows have none. Other rows stay as they are.
    """
    names = list(book["field_specs"])
    touched = edits.select(key).distinct().withColumn("_touched", F.lit(True))
    out, unknown = review.merge_edits(rows.join(touched, key, "left"), edits, names, key)
    out = out.withColumn("_held", F.when(F.col("_touched"), F.col("manual")).otherwise(F.array(*map(F.lit, names))))
    reads = lambda spec: spec.get("from") == "expr" and any(p.startswith("field.") for p in X.paths(X.parse(spec["expr"])))
    derived = [n for n in names if reads(book["fields"].get(n, {}))]
    out = engine.recompute_derived(out, book, derived, engine.Scope({}, out), "_held")
    differs = F.filter(F.array(*(F.when(~F.col(n).eqNullSafe(F.col(f"{n}_original")), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    out = out.withColumn("edited", F.array_sort(differs))
    cells = F.create_map(*(c for n in names for c in (F.lit(n), F.col(n))))
    carried = F.filter("issues", lambda i: (i["code"] == "CHUNK_FAILED") | ((i["code"] == "LIKELY_MISSED") & blank(cells[i["field"]])))
    anew = review.dedupe_issues(F.concat(carried, engine._kept(engine.row_validation(book["field_specs"]))))
    gone = F.array().cast(f"array<{engine.ISSUE}>")
    out = out.withColumn("issues", F.when(F.col("_touched") & F.col("deleted"), gone).when(F.col("_touched"), anew).otherwise(F.col("issues")))
    return out.drop("_touched", "_held"), unknown
