"""Review and send operators: issue distribution, edits, summaries, totals, payloads, status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import summary_number, totals_number
from ..functions.text import blank, strip


def distribute_issues(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, row_id, field, severity, code) of every row that an issue concerns.

    issues: doc_id, scope (line, order or document), ship_idx, line_idx, leaf, severity, code. A line's issue goes to its row, an
    order's to all its rows, and what finds no row to all rows of the document, as do document issues.
    """
    spots = rows.select("doc_id", "ship_idx", F.col("line_no").alias("line_idx"), "row_id")
    by_line = issues.filter("scope = 'line'").join(spots, ["doc_id", "ship_idx", "line_idx"])
    by_order = issues.filter("scope = 'order'").join(spots.drop("line_idx"), ["doc_id", "ship_idx"])
    lost_line = issues.filter("scope = 'line'").join(spots, ["doc_id", "ship_idx", "line_idx"], "left_anti")
    lost_order = issues.filter("scope = 'order'").join(spots, ["doc_id", "ship_idx"], "left_anti")
    wide = issues.filter("scope = 'document'").unionByName(lost_line).unionByName(lost_order).join(spots.select("doc_id", "row_id"), "doc_id")
    out = lambda df, field: df.select("doc_id", "row_id", field.alias("field"), "severity", "code")
    return out(by_line, F.col("leaf")).unionByName(out(by_order, F.lit(""))).unionByName(out(wide, F.lit("")))


def dedupe_issues(issues: Column) -> Column:
    """Issues without repeats by (field, code, message); the first stays."""
    same = lambda a, b: (a["field"] == b["field"]) & (a["code"] == b["code"]) & (a["message"] == b["message"])
    return F.filter(issues, lambda x, i: ~F.exists(F.slice(issues, F.lit(1), i), lambda y: same(x, y)))


def merge_edits(rows: DataFrame, edits: DataFrame, fields: list[str], key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows with edits applied, and the edits of unknown rows.

    edits: key, deleted (null: as it was) and some of the fields (null: untouched); other columns are ignored. A changed field joins
    `manual`; `edited` lists fields that differ from `<field>_original`, where that column exists, or from the value before.
    """
    known = [c for c in fields if c in edits.columns]
    new = edits.select(key, *[F.col(c).alias(f"_n_{c}") for c in known], *(["deleted"] if "deleted" in edits.columns else [])).withColumnRenamed("deleted", "_deleted")
    out = rows.join(new, key, "left")
    changed = F.filter(F.array(*[F.when(F.col(f"_n_{c}").isNotNull() & (F.col(f"_n_{c}") != F.col(c)), F.lit(c)) for c in known]), lambda x: x.isNotNull())
    manual = F.array_sort(F.array_union("manual", changed)) if "manual" in rows.columns else F.array_sort(changed)
    out = out.withColumn("manual", manual)
    if "_deleted" in out.columns:
        out = out.withColumn("deleted", F.coalesce("_deleted", F.col("deleted") if "deleted" in rows.columns else F.lit(False)))
    differs = [F.when(F.coalesce(f"_n_{c}", c) != (F.col(f"{c}_original") if f"{c}_original" in rows.columns else F.col(c)), F.lit(c)) for c in known]
    out = out.withColumn("edited", F.filter(F.array(*differs), lambda x: x.isNotNull()) if differs else F.array().cast("array<string>"))
    for c in known:
        out = out.withColumn(c, F.coalesce(f"_n_{c}", c))
    return out.drop("_deleted", *[f"_n_{c}" for c in known]), edits.join(rows, key, "left_anti")


def bulk_fill(rows: DataFrame, field: str, value: str, blank_only: bool = True) -> DataFrame:
    """One column set on blank (or all) live rows. Where rows have the array column `manual`, it tells that a person changed the field."""
    hit = ~F.col("deleted") & (blank(strip(F.col(field))) if blank_only else F.lit(True))
    if "manual" in rows.columns:
        changed = hit & ~F.col(field).eqNullSafe(F.lit(value))
        rows = rows.withColumn("manual", F.when(changed, F.array_union("manual", F.array(F.lit(field)))).otherwise(F.col("manual")))
    return rows.withColumn(field, F.when(hit, F.lit(value)).otherwise(F.col(field)))


def carried_issues(issues: Column, is_blank: Column, strict: bool = False) -> Column:
    """What survives an edit: CHUNK_FAILED always, LIKELY_MISSED while the cell is blank. strict keeps all but row validation's codes."""
    if strict:
        return F.filter(issues, lambda x: ~x["code"].isin("REQUIRED_MISSING", "ZERO", "TOO_LONG"))
    return F.filter(issues, lambda x: (x["code"] == "CHUNK_FAILED") | ((x["code"] == "LIKELY_MISSED") & is_blank))


def summary(rows: DataFrame, qty: str, by: list[str]) -> DataFrame:
    """Live rows, whole quantities, errors and warnings."""
    live = rows.filter(~F.col("deleted"))
    level = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s)))
    return live.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(summary_number(F.col(qty))).alias("qty"), level("error").alias("errors"), level("warn").alias("warnings"))


def verdict(printed: Column, counted: Column, judged: Column) -> Column:
    """'' if there is nothing to compare, else 'true' or 'false'."""
    return F.when(printed.isNull() | ~judged, "").when(printed == counted, "true").otherwise("false")


def totals(files: DataFrame, rows: DataFrame, qty: str, price: str) -> DataFrame:
    """A row for each file, those without rows too, and one for all (file null): n_rows, qty, amount, n_no_price, and verdicts.

    files: file, printed_qty, printed_amount, printed_lines, split. Amounts aren't judged where a price is missing, nor lines of a split
    document.
    """
    q, p = totals_number(F.col(qty)), totals_number(F.col(price))
    live = rows.filter(~F.col("deleted")).select("file", F.lit(1).alias("one"), F.coalesce(q, F.lit(0)).alias("q"), (q * p).cast("decimal(38,6)").alias("a"), p.isNull().cast("int").alias("np"))
    joined = files.select("file").join(live, "file", "left").rollup("file").agg(F.grouping("file").alias("grand"), F.count("one").alias("n_rows"), F.coalesce(F.sum("q"), F.lit(0)).alias("qty"), F.coalesce(F.sum("a"), F.lit(0)).alias("amount"), F.coalesce(F.sum("np"), F.lit(0)).alias("n_no_price"))
    out = joined.join(files, "file", "left")
    yes = F.lit(True)
    return out.select("file", "grand", "n_rows", "qty", "amount", "n_no_price", verdict(totals_number(F.col("printed_qty")), F.col("qty"), yes).alias("qty_ok"), verdict(totals_number(F.col("printed_amount")), F.col("amount"), F.col("n_no_price") == 0).alias("amount_ok"), verdict(F.col("printed_lines"), F.col("n_rows"), ~F.col("split")).alias("lines_ok"))


def batch_status(rows: DataFrame, files: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, status): PARSING, then a sticky sending state, then NEEDS_REVIEW with any error or no live row, then READY."""
    parsing = files.groupBy(key).agg(F.bool_or(F.col("status") == "PARSING").alias("parsing"), F.max(F.when(F.col("status").isin("SENDING", "SENT"), F.col("status"))).alias("sending"))
    state = rows.filter(~F.col("deleted")).groupBy(key).agg(F.count("*").alias("live"), F.bool_or(F.exists("issues", lambda x: x["severity"] == "error")).alias("bad"))
    joined = parsing.join(state, key, "left")
    status = F.when(F.col("parsing"), "PARSING").when(F.col("sending").isNotNull(), F.col("sending")).when(F.coalesce("bad", F.lit(False)) | (F.coalesce("live", F.lit(0)) == 0), "NEEDS_REVIEW").otherwise("READY")
    return joined.select(key, status.alias("status"))


def stale_status(status: Column, created: Column, now: Column, minutes: int) -> Column:
    """A PARSING batch older than the limit is shown as FAILED; an unreadable time gives no verdict."""
    at = F.try_to_timestamp(created)
    return F.when((status == "PARSING") & (at < now - F.make_dt_interval(mins=F.lit(minutes))), "FAILED").otherwise(status)


def issue_groups(rows: DataFrame) -> DataFrame:
    """(field, code, message, n_rows): REQUIRED_MISSING by field alone."""
    each = rows.select("row_id", F.explode("issues").alias("i"))
    text = F.when(F.col("i.code") == "REQUIRED_MISSING", F.lit("")).otherwise(F.col("i.message"))
    return each.groupBy(F.col("i.field").alias("field"), F.col("i.code").alias("code"), text.alias("message")).agg(F.countDistinct("row_id").alias("n_rows"))


def payload_chunks(rows: DataFrame, columns: list[str], order: list, max_rows: int, by: list[str]) -> DataFrame:
    """(by, chunk, n_rows, rows): the live rows as JSON objects, absent values as '', in slices of max_rows (0: one slice)."""
    live = rows.filter(~F.col("deleted"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    body = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]))
    cut = live.select(*by, n.alias("_n"), body.alias("_b")).withColumn("chunk", F.floor(F.col("_n") / max_rows) if max_rows > 0 else F.lit(0).cast("long"))
    lists = cut.groupBy(*by, "chunk").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("_n", "_b"))).alias("_l"))
    return lists.select(*by, "chunk", "n_rows", F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_b"]), ","), F.lit("]")).alias("rows"))


def order_keys(rows: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """(by, keys): distinct non-blank keys in the order in which they first stand."""
    firsts = rows.filter(~blank(F.col(key))).groupBy(*by, key).agg(F.min(order).alias("_o"))
    lists = firsts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(key).alias("k")))).alias("_l"))
    return lists.select(*by, F.transform("_l", lambda x: x["k"]).alias("keys"))


def send_gate(status: Column, unknown: Column, live: Column, errors: Column) -> Column:
    """The first refusal: 409 while sending, 400 for unknown rows, 409 without rows, 409 with errors; 200 if there is none."""
    return F.when(status.isin("SENDING", "SENT"), 409).when(unknown > 0, 400).when(live == 0, 409).when(errors > 0, 409).otherwise(200)


def upload_refused(files: DataFrame, order: str, size: str, by: list[str], most_files: int = 50, most_each: int = 20 << 20, most_all: int = 100 << 20) -> DataFrame:
    """Adds `refused`: files over the limits on count, size and running total."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("refused", (F.count("*").over(w) > most_files) | (F.col(size) > most_each) | (F.sum(size).over(w) > most_all))


def grounding_totals(lines: DataFrame, printed: DataFrame, doc: str, qty: str) -> DataFrame:
    """(doc, lines_ok, qty_ok): counted lines and quantities against printed ones; null where nothing is printed."""
    from ..functions.numbers import grounding_number

    counted = lines.groupBy(doc).agg(F.count("*").alias("n"), F.sum(grounding_number(F.col(qty))).alias("q"))
    return printed.join(counted, doc, "left").select(doc, (F.coalesce("n", F.lit(0)) == F.col("line_count")).alias("lines_ok"), (F.coalesce("q", F.lit(0)) == grounding_number(F.col("total_qty"))).alias("qty_ok"))


def rule_book_view(book: Mapping, spark) -> DataFrame:
    """The rule book as rows: section, name, kind, detail."""
    rows = [("table", t.get("name", ""), "decision_table", str(len(t["rows"]))) for t in book.get("tables", [])]
    rows += [("rule", n, r["kind"], str(r.get("source", ""))) for n, r in book.get("rules", {}).items()]
    rows += [("field", n, f["from"], str(f.get("value", f.get("path", f.get("rule", f.get("expr", "")))))) for n, f in book["fields"].items()]
    return spark.createDataFrame(rows, "section string, name string, kind string, detail string")
