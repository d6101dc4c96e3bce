"""Batches of files: each file's payload becomes rows with its issues, and what goes wrong with one file stays with it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .engine import GROUP_KEYS, HEADER_KEYS, ISSUE, LINE_KEYS, SHIPMENT_KEYS, build_rows
from .payloads import ground_payloads, lines_of, listed, mark, part, payload_rows, read_payloads, whole
from .review import dedupe_issues

#: How many reasons a file without rows tells.
REASONS = 3


#: Where the issues of a whole document stand among its lines: before all.
WHOLE = -1


def issue_places(issues: DataFrame, split: DataFrame) -> DataFrame:
    """(doc_id, path, level, code) with ship_idx and line_no of the row that an issue concerns, both WHOLE where it concerns all rows of the document.

    split: doc_id, split (whether rows come from shipments). Header, totals and missing lines concern all rows, and so do lines that a split document
    has above its shipments.
    """
    line = r"\A(?:shipments\[(\d+)\]\.)?lines\[(\d+)\]\.(.+)\z"
    number = lambda i: F.coalesce(F.regexp_extract("path", line, i).try_cast("int"), F.lit(0))
    lands = F.col("path").rlike(line) & ((number(1) > 0) | ~F.col("split"))
    at = lambda i: F.when(lands, number(i)).otherwise(WHOLE)
    return issues.join(split, "doc_id").select("doc_id", "path", "level", "code", at(1).alias("ship_idx"), at(2).alias("line_no"), F.when(lands, F.regexp_extract("path", line, 3)).otherwise("").alias("field"))


def spread_issues(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """rows (doc_id, ship_idx, line_no, issues, others) with what issue_places tells of them added to their issues, without repeats. Rows and
    issues meet in one sort by document, so that no document's issues are copied around."""
    issue = F.struct("field", F.col("level").alias("severity"), "code", F.col("path").alias("message"))
    told = issues.groupBy("doc_id", "ship_idx", "line_no").agg(F.array_sort(F.collect_list(issue)).alias("_found"))
    place = ["doc_id", "ship_idx", "line_no"]
    rest = [c for c in rows.columns if c not in place]
    left = rows.select(*place, F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"), F.lit(None).cast(f"array<{ISSUE}>").alias("_found"))
    both = left.unionByName(told.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("ship_idx", "line_no", "_kind")
    before = F.lag(F.struct("ship_idx", "line_no", "_found")).over(order)
    whole = F.first(F.when(F.col("ship_idx") == WHOLE, F.col("_found")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"_before": before, "_whole": whole}).filter("_kind = 1")
    none = F.array().cast(f"array<{ISSUE}>")
    own = F.when((F.col("_before.ship_idx") == F.col("ship_idx")) & (F.col("_before.line_no") == F.col("line_no")), F.col("_before._found"))
    all_ = F.concat("_row.issues", F.coalesce(own, none), F.coalesce("_whole", none))
    return found.select(*place, *(F.col("_row")[c].alias(c) for c in rest if c != "issues"), dedupe_issues(all_).alias("issues"))


def told_order(path: Column) -> Column:
    """In which order reasons are told: header, values of lines and shipments, totals, missing lines."""
    return F.when(F.startswith(path, F.lit("header.")), 0).when(F.startswith(path, F.lit("totals.")), 2).when(path == "lines", 3).when(path.rlike(r"\Ashipments\[\d+\]\.lines\z"), 4).otherwise(1)


def texts_in(book: object) -> Iterator[str]:
    """Every text of a rule book, names too."""
    if isinstance(book, str):
        yield book
    elif isinstance(book, Mapping):
        yield from (text for pair in book.items() for x in pair for text in texts_in(x))
    elif isinstance(book, Sequence):
        yield from (text for x in book for text in texts_in(x))


def keys_used(book: Mapping) -> set[str]:
    """The keys of extractions that a rule book may read: those that stand in any of its texts, and what labels a group."""
    texts = "\n".join(texts_in(book))
    return {k for k in (*HEADER_KEYS, *SHIPMENT_KEYS, *LINE_KEYS, "extra") if k in texts} | set(GROUP_KEYS)


def parse_batch(files: DataFrame, payloads: DataFrame, documents: DataFrame, book: Mapping, extra_fields: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of batches, and the state of their files.

    files: batch_id, file_id, place (in its batch), error (why the file couldn't be read, or null). payloads: file_id, payload. documents: file_id, lines,
    has_text, anchored.
    Rows: batch_id, file_id, row_id (numbered through the batch, r_0001 first), group, line_no, the book's fields, issues (the engine's, then
    grounding's on the rows that they concern, without repeats).
    States: batch_id, file_id, status, error, row_count, doc_line_count, doc_total_qty, doc_total_amount, doc_split. A file fails with its own error, with a
    payload that is missing or can't be read, or if it has no rows and grounding found errors; then three of these are told, and how many more there are. A
    file without rows and errors is done.
    """
    own = files.select("batch_id", F.col("file_id").alias("doc_id"), "place", "error")
    # Both are used many times: kept on the executors' disks, they are made once, and no filter goes below the parsing.
    # Files and payloads are dealt by document, whatever their sizes: a broadcast of payloads would leave them where few partitions of files are.
    sent = payloads.withColumnRenamed("file_id", "doc_id").hint("merge")
    parsed = read_payloads(own.filter("error IS NULL").select("doc_id").join(sent, "doc_id", "left"))
    # For counting, lines are read as what builds nothing of them.
    v, bare = F.col("_v"), "array<boolean>"
    ships = listed(v, "shipments", f"array<struct<lines:{bare}>>")
    n_rows = F.when(F.size(ships) > 0, F.aggregate(ships, F.lit(0), lambda a, x: a + F.size(lines_of(x, bare)))).otherwise(F.size(listed(v, "lines", bare))).cast("long")
    parsed = parsed.withColumns({"_n_rows": n_rows, "_split": F.size(listed(v, "shipments", bare)) > 0}).persist(StorageLevel.DISK_ONLY)
    n_rows, split, t = F.col("_n_rows"), F.col("_split"), part(v, "totals")
    read = parsed.drop("_n_rows", "_split")
    documents = documents.withColumnRenamed("file_id", "doc_id").persist(StorageLevel.DISK_ONLY)

    text = lambda k: F.coalesce(F.try_variant_get(part(t, k), "$", "string"), F.lit("")).alias(f"doc_{k}")
    lines = F.coalesce(whole(part(t, "line_count"), mark(part(t, "line_count"))).cast("string"), F.lit("")).alias("doc_line_count")
    printed = parsed.select("doc_id", F.col("problem").alias("_problem"), F.when(F.col("problem").isNull(), n_rows).otherwise(0).alias("_rows"), lines, text("total_qty"), text("total_amount"), split.alias("doc_split"))
    placed = own.join(printed, "doc_id", "left").withColumn("row_count", F.coalesce("_rows", F.lit(0)).cast("long"))
    # Over the files of one batch, of which there are few.
    order = Window.partitionBy("batch_id").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("row_count").over(order), F.lit(0)))

    # Rule books read values, and no anchors.
    built = build_rows(payload_rows(read, extra_fields, keys_used(book), anchored=False), book, ["ship_idx"])
    found = issue_places(ground_payloads(read, documents), parsed.select("doc_id", split.alias("split")))
    rows = spread_issues(built, found)
    number = F.regexp_extract("row_id", r"(\d+)\z", 1).cast("long") + F.col("_before")
    fields = [c for c in built.columns if c not in ("doc_id", "row_id", "ship_idx", "issues")]
    rows = rows.join(placed.select("batch_id", "doc_id", "_before"), "doc_id").select("batch_id", F.col("doc_id").alias("file_id"), F.format_string("r_%04d", number).alias("row_id"), *fields, "issues")

    found = ground_payloads(parsed.filter(n_rows == 0).drop("_n_rows", "_split"), documents)
    errors = found.filter("level = 'error'").withColumn("_at", told_order(F.col("path")))
    reasons = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_at", "path", "code"))), 1, REASONS), lambda x: F.concat(x["path"], F.lit(": "), x["code"]))
    more = F.when(F.count("*") > REASONS, F.concat(F.lit(" (and "), (F.count("*") - REASONS).cast("string"), F.lit(" more)"))).otherwise("")
    reasons = errors.groupBy("doc_id").agg(F.concat(F.array_join(reasons, " / "), more).alias("_reasons"))
    states = placed.join(reasons, "doc_id", "left")
    why = F.coalesce("error", "_problem", "_reasons")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    states = states.select(
        "batch_id", F.col("doc_id").alias("file_id"), F.when(why.isNull(), "DONE").otherwise("FAILED").alias("status"), F.coalesce(why, F.lit("")).alias("error"), "row_count",
        *map(blank, ("doc_line_count", "doc_total_qty", "doc_total_amount")), F.coalesce("doc_split", F.lit(False)).alias("doc_split"),
    )
    return rows, states
