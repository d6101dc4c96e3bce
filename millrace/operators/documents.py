"""Document operators: numbered lines, slices, chunk plans, their validation, and the merge of chunk results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_lines(docs: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """(key, n, page, text): lines numbered through the document; each page begins with a header line, which takes a number too."""
    paged = docs.select(key, F.posexplode(pages).alias("_p", "_page"))
    lines = paged.select(key, (F.col("_p") + 1).alias("page"), F.posexplode(F.concat(F.array(F.format_string("===== PAGE %d =====", F.col("_p") + 1)), F.split("_page", "\n", -1))).alias("_l", "text"))
    order = Window.partitionBy(key).orderBy("page", "_l")
    return lines.select(key, F.row_number().over(order).alias("n"), "page", "text")


def numbered(n: Column, text: Column) -> Column:
    """'L000123| text'."""
    return F.concat(F.lit("L"), F.when(n < 1_000_000, F.lpad(n.cast("string"), 6, "0")).otherwise(n.cast("string")), F.lit("| "), text)


def slice_text(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, clamped to the document), joined by newlines; '' if there are none."""
    at = F.greatest(F.lit(1), first)
    n = F.greatest(F.lit(0), F.least(last, F.size(lines)) - at + 1)
    return F.array_join(F.slice(lines, at, n), "\n")


def excerpt(lines: Column, start: Column, end: Column, header_context: int = 40) -> tuple[Column, Column]:
    """The head of the document before a chunk (header_context lines at most, no overlap), and the chunk."""
    head = F.least(F.lit(header_context), start - 1)
    return slice_text(lines, F.lit(1), head), slice_text(lines, start, end)


def line_limit(max_lines: int, max_tokens: int, safety_ratio: float, tokens_per_line: float) -> int:
    return max(1, min(max_lines, int(max_tokens * safety_ratio // tokens_per_line)))


def chunk_plan(blocks: DataFrame, limit: int, tail: int = 0, enabled: bool = True, doc: str = "doc_id") -> DataFrame:
    """Blocks (doc, ship_idx, src, src_end) cut into equal chunks of `limit` lines at most; the first ones take the lines left over.

    Returns doc, ship_idx, part, start, end, read_end (null for a block's last chunk), mid_block.
    """
    length = F.col("src_end") - F.col("src") + 1
    parts = F.ceil(length / limit).cast("int") if enabled else F.lit(1)
    rows = blocks.withColumn("_parts", parts).withColumn("_size", F.floor(length / F.col("_parts")).cast("int")).withColumn("_extra", (length % F.col("_parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    start = F.col("src") + F.col("part") * F.col("_size") + F.least("part", "_extra")
    rows = rows.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.col("_size") + (F.col("part") < F.col("_extra")).cast("int") - 1).cast("int"))
    read_end = F.when(F.col("end") < F.col("src_end"), F.least(F.col("end") + tail, F.col("src_end"))).cast("int")
    return rows.select(doc, "ship_idx", F.col("part").cast("int").alias("part"), "start", "end", read_end.alias("read_end"), (F.col("part") > 0).alias("mid_block"))


def block_problems(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All problems of all blocks (doc, ship_idx, src, src_end, n_lines): missing, reversed, outside, overlap (with the block before, by
    src and end)."""
    missing = F.col("src").isNull() | F.col("src_end").isNull()
    before = F.lag("src_end").over(Window.partitionBy(doc).orderBy("src", "src_end", "ship_idx"))
    known = blocks.filter(~missing).withColumn("_before", before)
    tests = [("reversed", F.col("src") > F.col("src_end")), ("outside", (F.col("src") < 1) | (F.col("src_end") > F.col("n_lines"))), ("overlap", F.coalesce(F.col("_before") >= F.col("src"), F.lit(False)))]
    found = F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests]), lambda x: x.isNotNull())
    rest = known.select(doc, "ship_idx", F.explode(found).alias("problem"))
    return blocks.filter(missing).select(doc, "ship_idx", F.lit("missing").alias("problem")).unionByName(rest)


def merge_chunks(items: DataFrame, doc: str = "doc_id", unit: str = "ship_idx") -> DataFrame:
    """Chunk results as one list of lines, whatever order they came in.

    items: doc, unit, chunk_index, start, end, tail_end (null: none), pos, src and further columns. Items that begin in the tail, which
    the next chunk reads too, are dropped; of items with one src in a unit the first stays (a null src is never a repeat); line_no
    restarts in each unit.
    """
    order = ["chunk_index", "start", "pos"]
    tail = F.coalesce((F.col("src") > F.col("end")) & (F.col("src") <= F.col("tail_end")), F.lit(False))
    rows = items.filter(~tail)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(doc, unit, "src").orderBy(*order))).filter("_rn = 1 OR src IS NULL").drop("_rn")
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(doc, unit).orderBy(*order)))


def halves(start: Column, end: Column, depth: int, number: int = 1) -> list[tuple[int, Column, Column]]:
    """(number, start, end) of a range and of its halves, `depth` times over, numbered as a binary tree; the first half has the middle line."""
    if not depth:
        return [(number, start, end)]
    middle = F.floor((start + end) / 2).cast("int")
    return [(number, start, end), *halves(start, middle, depth - 1, 2 * number), *halves(middle + 1, end, depth - 1, 2 * number + 1)]


def read_pieces(chunks: DataFrame, answers: DataFrame, tail: int = 0, depth: int = 2, doc: str = "doc_id", unit: str = "ship_idx") -> DataFrame:
    """The pieces that chunks were read in: a chunk whose answer was cut off is read by halves, `depth` times at most.

    chunks: doc, unit, chunk_index, start, end, read_end (null: none). answers: doc, start, end, state (ok, truncated, failed), one for each range that was asked for. Returns doc,
    unit, chunk_index, start, end, tail_end, failed: the ranges that make up each chunk. A piece fails alone: with a failed or missing answer, or cut off at
    the last depth or at a single line. The ranges of a chunk are few, so that they are one row while they are judged.
    """
    base_end = F.coalesce("read_end", "end")
    tree = F.array(*(F.struct(F.lit(n).alias("number"), a.cast("int").alias("start"), b.cast("int").alias("end")) for n, a, b in halves(F.col("start"), F.col("end"), depth)))
    asked = chunks.select(doc, unit, "chunk_index", base_end.alias("_base"), F.explode(F.filter(tree, lambda x: x["start"] <= x["end"])).alias("_x")).select(doc, unit, "chunk_index", "_base", "_x.*")
    told = asked.join(answers.select(doc, "start", "end", "state"), [doc, "start", "end"], "left")
    nodes = told.groupBy(doc, unit, "chunk_index", "_base").agg(F.collect_list(F.struct("number", "start", "end", "state")).alias("_nodes"))
    cut = lambda x: F.coalesce(x["state"] == "truncated", F.lit(False)) & (x["end"] > x["start"])

    was_cut = lambda number: (number == 0) | F.exists("_nodes", lambda y: (y["number"] == number) & cut(y))

    def reached(x: Column) -> Column:
        test = F.lit(True)
        for up in range(1, depth + 1):
            test = test & was_cut(F.shiftright(x["number"], up))
        return test

    last = 1 << depth
    pieces = F.filter("_nodes", lambda x: reached(x) & (~cut(x) | (x["number"] >= last)))
    rows = nodes.select(doc, unit, "chunk_index", "_base", F.explode(pieces).alias("_p")).select(doc, unit, "chunk_index", "_base", "_p.*")
    tail_end = F.when(F.col("end") < F.col("_base"), F.least(F.col("end") + tail, F.col("_base"))).otherwise(F.col("end"))
    return rows.select(doc, unit, "chunk_index", "start", "end", tail_end.cast("int").alias("tail_end"), F.coalesce(F.col("state") != "ok", F.lit(True)).alias("failed"))


def merge_pieces(pieces: DataFrame, items: DataFrame, doc: str = "doc_id", unit: str = "ship_idx") -> tuple[DataFrame, DataFrame]:
    """The lines of documents from the pieces that were read, and the issues of the pieces.

    items: doc, start, end (the range that was asked for), pos, src, others. Lines: as merge_chunks gives them, with lo and hi, the lines that a piece may
    point at. Issues: doc, unit, chunk_index, start, end, severity, code: CHUNK_FAILED, EMPTY_CHUNK, or DUPLICATE_LINE for each line read twice.
    """
    good = pieces.filter(~F.col("failed"))
    read = good.join(items, [doc, "start", "end"]).withColumns({"lo": F.col("start"), "hi": F.col("tail_end")})
    lines = merge_chunks(read, doc, unit)
    # All issues from one join and one window: a piece without items, and one that failed, is a row too.
    told = pieces.filter("failed IS NOT NULL").withColumn("_good", F.when(~F.col("failed"), True))
    told = told.join(items.select(doc, "start", "end", "pos", "src", F.lit(True).alias("_good"), F.lit(True).alias("_item")), [doc, "start", "end", "_good"], "left")
    tail = F.coalesce((F.col("src") > F.col("end")) & (F.col("src") <= F.col("tail_end")), F.lit(False))
    told = told.withColumn("_counts", F.col("_item").isNotNull() & ~tail & F.col("src").isNotNull())
    again = Window.partitionBy(doc, unit, "src", "_counts").orderBy("chunk_index", "start", "pos")
    twice = F.col("_counts") & (F.row_number().over(again) > 1)
    code = F.when(F.col("failed"), "CHUNK_FAILED").when(F.col("_item").isNull(), "EMPTY_CHUNK").when(twice, "DUPLICATE_LINE")
    found = told.withColumn("code", code).filter("code IS NOT NULL")
    return lines, found.select(doc, unit, "chunk_index", "start", "end", F.when(F.col("failed"), "error").otherwise("warn").alias("severity"), "code")


def chunk_issues(chunks: DataFrame, items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk_index, severity, code): CHUNK_FAILED errors and EMPTY_CHUNK warnings. chunks: doc, chunk_index, failed."""
    counts = items.groupBy(doc, "chunk_index").agg(F.count("*").alias("_n"))
    rows = chunks.join(counts, [doc, "chunk_index"], "left").filter(F.col("failed") | F.col("_n").isNull())
    return rows.select(doc, "chunk_index", F.when(F.col("failed"), F.lit("error")).otherwise(F.lit("warn")).alias("severity"), F.when(F.col("failed"), F.lit("CHUNK_FAILED")).otherwise(F.lit("EMPTY_CHUNK")).alias("code"))
