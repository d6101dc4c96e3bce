"""Upkeep of reference tables, identifiers and batches: joins and filters over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The form of a batch's identifier, and the states in which it is being sent or has been.
BATCH_ID = r"\Ab_\d{8}_\d{4}\z"
SENT = ("SENDING", "SENT")


def text_of(c: Column) -> Column:
    """A cell as stripped text; '' for null."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def unregistered(outputs: DataFrame, registry: DataFrame, customer: str, value: str) -> DataFrame:
    """Rows of outputs whose value isn't among the registry's for their customer. Blank values need no registration."""
    known = registry.select(text_of(F.col(customer)).alias("_c"), text_of(F.col(value)).alias("_v")).distinct()
    same = (text_of(outputs[customer]) == known["_c"]) & (text_of(outputs[value]) == known["_v"])
    return outputs.filter(text_of(F.col(value)) != "").join(known, same, "left_anti")


def set_rows(rows: DataFrame, edits: DataFrame, key: str, values: list[str], order: str = "_ord") -> DataFrame:
    """rows with single rows replaced in place by those of edits. A key that is new comes after all others; one whose values are all blank
    goes. Edits without a key are left out; of edits of one key the last by `order` counts."""
    last = edits.withColumn("_k", text_of(F.col(key))).filter("_k <> ''").groupBy("_k").agg(F.max_by(F.struct(*[text_of(F.col(v)).alias(v) for v in values], F.col(order).alias("_at")), order).alias("_e"))
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    kept = rows.join(last, rows[key] == last["_k"], "left_anti").select(key, *values, F.lit(0).alias("_new"), F.col(order).cast("long").alias(order))
    filled = F.concat(*[F.col("_e")[v] for v in values]) != ""
    fresh = last.filter(filled).join(first, last["_k"] == first[key], "left")
    fresh = fresh.select(F.col("_k").alias(key), *[F.col("_e")[v].alias(v) for v in values], F.col("_first").isNull().cast("int").alias("_new"), F.coalesce("_first", "_e._at").cast("long").alias(order))
    return kept.unionByName(fresh)


def correction_notes(new: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """(note, keys) of manual rows that an import makes doubtful: `broken` overrides and `stale` suppressions whose pair is gone, `landed`
    additions whose pair has come."""
    here = new.select(*keys).distinct().withColumn("_here", F.lit(True))
    note = F.when((F.col("action") == "override") & F.col("_here").isNull(), "broken").when((F.col("action") == "suppress") & F.col("_here").isNull(), "stale").when((F.col("action") == "add") & F.col("_here"), "landed")
    return manual.join(here, keys, "left").withColumn("note", note).filter("note IS NOT NULL").select("note", *keys)


def sheet_records(sheet: DataFrame, columns: Mapping[str, str], fill: Mapping[str, str]) -> DataFrame:
    """Rows of an edited sheet under the names of the file's columns: rows that are blank in all of them go, blank cells are filled."""
    cells = sheet.select(*[text_of(F.col(f"`{head}`")).alias(name) for head, name in columns.items()])
    cells = cells.filter(F.concat(*[F.col(n) for n in columns.values()]) != "")
    return cells.select(*[F.when(F.col(n) == "", F.lit(fill[n])).otherwise(F.col(n)).alias(n) if n in fill else F.col(n) for n in columns.values()])


def next_ids(used: DataFrame, day: str, number: str, most: int = 9_999) -> DataFrame:
    """(day, batch_id): for each day the least number from 1 to `most` that isn't used, as b_YYYYMMDD_NNNN; null if there is none left."""
    taken = used.select(day, F.col(number).cast("int").alias("_n")).filter(F.col("_n").between(1, most)).distinct()
    placed = taken.withColumn("_rn", F.row_number().over(Window.partitionBy(day).orderBy("_n")))
    # Numbers up to the first gap are as large as their places.
    free = placed.groupBy(day).agg(F.coalesce(F.min(F.when(F.col("_n") > F.col("_rn"), F.col("_rn"))), F.count("*").cast("int") + 1).alias("_free"))
    return free.select(day, F.when(F.col("_free") <= most, F.format_string("b_%s_%04d", day, "_free")).alias("batch_id"))


def is_batch_id(c: Column) -> Column:
    return F.coalesce(c.rlike(BATCH_ID), F.lit(False))


def upload_name(file_id: Column, name: Column) -> Column:
    """file_id__name, where runs of unsafe characters of the name's last part are one `_`; `upload` if nothing is left."""
    base = F.element_at(F.split(name, "/"), -1)
    safe = F.trim(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.concat(file_id, F.lit("__"), F.when(safe == "", "upload").otherwise(safe))


def extension(name: Column) -> Column:
    """The lower-case extension of a file name, without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def unexpected_type(ext: Column, allowed: Column) -> Column:
    """UNEXPECTED_FILE_TYPE where a book names kinds of files (an array, in any case) and this is none of them; a warning, as the file is read all the same."""
    return F.when((F.size(allowed) > 0) & ~F.array_contains(F.transform(allowed, F.lower), F.lower(ext)), "UNEXPECTED_FILE_TYPE")


def is_transient(status: Column, error: Column) -> Column:
    """A failure that may pass: by its status (429, 500 and above), or by its name if there is none."""
    return F.when(status.isNotNull(), (status == 429) | (status >= 500)).otherwise(F.coalesce(error.rlike("Timeout|Connection"), F.lit(False)))


def may_validate(status: Column) -> Column:
    """Rows of a batch can be validated until it is sent."""
    return ~status.isin(*SENT)


def stamp_pages(values: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """values with `page` from the line that they point at (key, src), whatever was read; null where there is no such line."""
    at = lines.select(F.col(key).alias("_d"), F.col("n").alias("_n"), F.col("page").alias("_p"))
    return values.join(at, (values[key] == at["_d"]) & (values["src"] == at["_n"]), "left").withColumn("page", F.col("_p")).drop("_d", "_n", "_p")


def no_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, code) of documents without a line, and of shipments without one. documents has `po`, a typed tree."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    units = F.coalesce("po.shipments", F.expr("slice(po.shipments, 1, 0)"))
    total = F.aggregate(F.coalesce(F.transform("po.shipments", lambda s: size(s["lines"])), F.array(F.lit(0))), F.lit(0), lambda a, n: a + n)
    lines = F.when(size(F.col("po.shipments")) > 0, total).otherwise(size(F.col("po.lines")))
    whole = F.when(lines == 0, F.array(F.lit("lines"))).otherwise(F.array().cast("array<string>"))
    bare = F.filter(F.transform(units, lambda s, i: F.when(size(s["lines"]) == 0, F.format_string("shipments[%d].lines", i + 1))), lambda f: f.isNotNull())
    fields = F.concat(whole, F.coalesce(bare, F.array().cast("array<string>")))
    return documents.select(key, F.explode(fields).alias("field"), F.lit("NO_LINES").alias("code"))


def column_order(columns: list[str], grid: Mapping, meta: tuple[str, ...] = (), show_all: bool = False) -> list[str]:
    """The columns of a review table: meta, pinned, others, and hidden ones at the end if asked for; columns that are only sent are out."""
    shown = [c for c in columns if c not in (grid.get("send_only") or [])]
    pinned = [c for c in grid.get("pinned") or [] if c in shown]
    hidden = [c for c in shown if c in (grid.get("hidden") or [])]
    return [*meta, *pinned, *(c for c in shown if c not in pinned and c not in hidden), *(hidden if show_all else [])]
