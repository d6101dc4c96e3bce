"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents stand in a keyed random order, and are repeated from its start as often as the target needs: a stream of words.
Streams are cut into blocks of equal size; a source's quota is its number of blocks. A splitting tree hands the blocks out: at each
node, half of the node's blocks, drawn without replacement, go left, so that the left side's blocks of each source are multivariate
hypergeometric. The leaves are output shards with disjoint blocks; a document occurrence goes where the block in which it begins goes.
Within a shard, blocks stand in the order in which they were drawn, and a block's documents are shuffled among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, fresh, written

SHARDS = 16
BLOCKS = 1 << 14
CELLS = 1024
MOST_TIMES = 3
WORD_COUNT = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"


def key(seed: int, *columns) -> Column:
    """A pseudo-random 64-bit key of a row: the same in every run."""
    return F.xxhash64(F.lit(seed), *columns)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) with each source's target added.

    Weights repeat over the sources by code point, null last. Targets share the total by weight, up to most_times a source's size; the
    excess is shared again by weight until none is above. With sources by rising cap / weight, a source is capped if its cap is below
    its share of what earlier caps leave; one pass settles it. Uncapped ones share what is left.
    """
    one = F.lit(0)
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", (F.col("source_size") * most_times).cast("double"))
    rising = Window.partitionBy(one).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(one)
    rows = rows.withColumn("_total", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_share", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    rows = rows.withColumn("_capped", F.col("_cap") <= F.col("_share") * F.col("_w"))
    # The first source that isn't capped sets the share of all that follow.
    rows = rows.withColumn("_rate", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), F.col("_share")))).over(every))
    return rows.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_rate._share") * F.col("_w")).alias("target"))


def split_blocks(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds `shard` and `place` (a random order) to (source, block) rows, by the splitting tree. shards: a power of two."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    rows = blocks.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        drawn = node.orderBy(key(seed + level, "source", "block"), F.col("source").asc_nulls_last(), "block")
        right = F.row_number().over(drawn) * 2 > F.count("*").over(node)
        rows = rows.withColumn("_right", right.cast("int")).withColumn("shard", F.col("shard") * 2 + F.col("_right")).drop("_right")
    order = Window.partitionBy("shard").orderBy(key(seed + levels, "source", "block"), F.col("source").asc_nulls_last(), "block")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns to keep: size is the number of words of the text, 0 if it is null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.expr(WORD_COUNT), F.lit(0)).cast("long").alias("size"), *keep)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 20, row_key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The mix of docs (with columns row_key, source, size), as two tables.

    drawn: one row for each row of docs, with source_size, target and `times`, how often the mix takes it (0 to 3).
    placed: one row for each time, with words (that it takes), shard, place (of its block in the shard) and slot (within the block).

    A source's whole rounds take each of its documents. The last round ends at the target: the document that lies across it gives
    its first words, so that what a source gives is its target to the word. A null source is a source of its own, last. Null and empty texts
    have size 0: they are taken in whole rounds alone. Rows that repeat are drawn each on their own; a null row_key is a key like
    others. Extra columns stay in `drawn`. An empty table gives empty ones.
    """
    rows = docs.withColumn("_cell", F.pmod(key(seed, row_key), F.lit(CELLS)).cast("int"))
    # Words before each cell of a source's order, then before each document of a cell: no task holds a source.
    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    sizes = cells.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights)
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *(a[c] == b[c] for c in more)]
    cells = written(cells.join(targets, same(cells, targets)).select(cells["source"].alias("_s"), F.col("_cell").alias("_c"), "_base", "source_size", "target"))
    within = Window.partitionBy("source", "_cell").orderBy(key(seed + 1, row_key), row_key, "size")
    rows = rows.withColumn("_at", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(cells, rows["source"].eqNullSafe(cells["_s"]) & (F.col("_cell") == F.col("_c"))).drop("_s", "_c")
    rows = rows.withColumn("_at", F.col("_base") + F.coalesce("_at", F.lit(0)))
    rounds = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-9)
    rest = F.round(F.col("target") - rounds * F.col("source_size"))
    rows = rows.withColumn("_rounds", F.least(rounds, F.lit(MOST_TIMES)).cast("int"))
    rows = rows.withColumn("_part", F.greatest(F.lit(0), F.least("size", rest - F.col("_at"))).cast("long"))
    rows = rows.withColumn("times", F.col("_rounds") + (F.col("_part") > 0).cast("int"))
    drawn = written(rows.drop("_cell", "_base"))

    total = drawn.agg(F.sum(F.col("_rounds") * F.col("size") + F.col("_part")).alias("n")).first()["n"] or 0
    block = max(1, -(-total // blocks))
    each = drawn.filter("times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_round"))
    each = each.withColumn("block", F.floor((F.col("_at") + (F.col("_round") - 1) * F.col("source_size")) / block))
    each = each.withColumn("words", F.when(F.col("_round") > F.col("_rounds"), F.col("_part")).otherwise(F.col("size"))).drop("_round", "_at", "_rounds", "_part")
    quotas = split_blocks(each.select("source", "block").distinct(), shards, seed + 2)
    quotas = written(quotas).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "shard", "place")
    shuffled = Window.partitionBy("shard", "place").orderBy(key(seed + 3, row_key, "times"), row_key)
    placed = each.join(F.broadcast(quotas) if blocks <= 1 << 16 else quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    return drawn.drop("_at", "_rounds", "_part"), placed.withColumn("slot", F.row_number().over(shuffled) - 1)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document, counted from its placed occurrences; then
    shard, place (of the block in the shard) and slot (in the block) of the first of them, null if it takes none."""
    drawn, placed = mix(sized(docs), weights, **options)
    taken = placed.groupBy("doc_id", "source", "size").agg(F.sum("words").alias("_taken"), F.min(F.struct("shard", "place", "slot")).alias("_first"))
    rows = drawn.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.count("*").alias("rows"))
    on = [rows[c].eqNullSafe(taken[c]) for c in ("doc_id", "source", "size")]
    out = rows.join(taken, on, "left").select(rows["doc_id"], rows["size"], "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("_taken"), "_first.*", "rows")
    # Rows that repeat share what was taken of them.
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_i")
    return out.select("doc_id", "size", "source_size", "target", F.floor(F.col("_taken") / F.col("rows")).alias("taken"), "shard", "place", "slot", each).drop("_i")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, with what lies between them."""
    pieces = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), n), ""), r"[\x20\x09-\x0D]+\z", "")


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it is drawn, with its columns as they were, of any name; where the mix takes a
    part, text is that part. Rows that repeat a doc_id are taken as the most drawn of them; rows with a null doc_id are taken each on
    its own."""
    row_id, row_hash, nth, parts, length, take = (fresh(docs, n) for n in ("row_id", "row_hash", "row_nth", "row_parts", "row_length", "row_take"))
    same = Window.partitionBy(row_hash).orderBy("text")
    unnamed = docs.filter("doc_id IS NULL").withColumn(row_hash, F.xxhash64("source", "text")).withColumn(nth, F.row_number().over(same))
    named = docs.filter("doc_id IS NOT NULL")
    keys = (row_hash, nth)
    no = {row_hash: F.lit(None).cast("long"), nth: F.lit(None).cast("int")}
    _, placed = mix(sized(named).withColumns(no).unionByName(sized(unnamed, keys)), weights, **options)
    placed = written(placed.select("doc_id", *keys, "size", "words"))
    taken = placed.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(row_id), "size").agg(F.collect_list("words").alias(parts))
    taken = written(taken.groupBy(row_id).agg(F.max_by(parts, F.size(parts)).alias(parts), F.first("size").alias(length)))
    rows = attach(named.withColumn(row_id, F.col("doc_id").cast("long")), taken, [row_id], "inner", row_bytes=48)
    alone = placed.filter("doc_id IS NULL").groupBy(*keys).agg(F.collect_list("words").alias(parts), F.first("size").alias(length))
    rows = rows.drop(row_id).unionByName(unnamed.join(alone, list(keys)).drop(*keys))
    rows = rows.withColumn(take, F.explode(parts))
    text = F.when(F.col(take) < F.col(length), first_words(F.col("text"), F.col(take).cast("int"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*(f"`{c}`" for c in docs.columns))
