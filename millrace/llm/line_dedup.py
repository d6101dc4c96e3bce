"""Fuzzy line dedup, with DataFrame operations only.

Lines are normalised to their words (lower case, parted by anything but letters and digits). Equal lines are one class. Classes are joined
on pigeonhole blocks: k changed words leave one of the k + 1 stretches between them whole, so lines of edit similarity 0.8 and five words
or more share a block of two neighbouring words. Of a line's blocks, the BLOCKS first by length and hash are its keys, where letters of a word count up to MOST_LETTERS.
Small buckets are compared whole, the lines of others with the bucket's hub, by edit similarity over words. Larger buckets that then still hold
several groups are compared whole too, but for pairs whose marks (parities of words, a few longs a line) differ by more than edits can turn. Of each connected group one occurrence stays: the first by doc_id (null
last) and line number.

The blocks are of the words, not of a SimHash: a changed word turns a seventh of a ten-word line's 64 SimHash bits, so that no split of
them into blocks finds pairs at the threshold (9 of 100 with one of ten words changed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, written
from .linking import WHOLE, grouped_by_rarity, met

SIMILARITY = 0.8
LEAST_WORDS = 5
BLOCKS = 5
#: Longs of a line's marks.
MARKS = 8
#: Letters of ASCII and digits are named first, as classes of single characters are looked up in a table.
APART = r"[^abcdefghijklmnopqrstuvwxyz0123456789\p{L}\p{N}]+"
#: A character of a script that is written without blanks is a word of its own, in lines that consist of such characters mostly.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Letters of a word that count towards the length of a block.
MOST_LETTERS = 6
#: A word's code is its length up to MOST_LETTERS and its hash folded to so many values; all codes fit the code points of five hexadecimal digits.
CODES = 0xF0000 // MOST_LETTERS


def line_words(line: Column) -> Column:
    """The words of a line in lower case; there can be an empty one at either end."""
    low = F.lower(line)
    wide = (F.octet_length(line) > 2 * F.length(line)) & line.rlike(UNSPACED)
    return F.split(F.when(wide, F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low), APART, -1)


def word_keys(line: Column) -> Column:
    """Each word of a line as its length in the top byte and 56 bits of its hash below."""
    keys = F.transform(line_words(line), lambda w: F.shiftleft(F.least(F.length(w), F.lit(MOST_LETTERS)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8)))
    return F.array_remove(keys, F.shiftrightunsigned(F.xxhash64(F.lit("")), 8))


def raw_lines(docs: DataFrame, of=lambda line: line) -> DataFrame:
    """(doc_id, line_no, line) of every line, or of something made of it; a null text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.transform(F.split("text", "\n", -1), of)).alias("line_no", "line"))


def word_codes(words: Column) -> Column:
    """The words of a line, from word_keys, as integers below 0xF0000: longer words have greater ones."""
    return F.transform(words, lambda w: ((F.shiftrightunsigned(w, 56) - 1) * CODES + F.pmod(w, F.lit(CODES))).cast("int"))


def blocks_of(codes: Column, make) -> Column:
    """make(x, y) of every two neighbouring words of a line."""
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), make)


def block_keys(words: Column, blocks: int = BLOCKS) -> Column:
    """The keys of a line (int), from word_keys: of two neighbouring words, the greatest sums, so those of the longest blocks, hashed."""
    greatest = F.slice(F.array_distinct(F.slice(F.sort_array(blocks_of(words, lambda x, y: x + y), asc=False), 1, 4 * blocks)), 1, blocks)
    return F.array_distinct(F.transform(greatest, lambda x: F.hash(x)))


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, line_no, k1, k2, words, keys) of every line that says something: two independent hashes and the number of its words, and
    its keys, none if it has under least_words words."""
    lines = raw_lines(docs, word_keys).filter("size(line) > 0")
    keys = F.when(F.size("line") >= least_words, block_keys(F.col("line"), blocks)).otherwise(F.array().cast("array<int>"))
    return lines.select("doc_id", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), F.size("line").alias("words"), keys.alias("keys"))


def word_marks(lines: DataFrame) -> DataFrame:
    """(item, m0, m1, ...), from (item, codes): which of 64 * MARKS classes of words a line has an odd number of words of, a bit each.

    A changed word turns two of these bits at most, a word more or less one.
    """
    words = lines.select("item", F.explode("codes").alias("code")).select("item", F.hash("code").alias("h"))
    of = [F.expr(f"bit_xor(if(pmod(shiftright(h, 6), {MARKS}) = {i}, shiftleft(1L, h & 63), 0L))").alias(f"m{i}") for i in range(MARKS)]
    return words.groupBy("item").agg(*of)


def may_be_alike(similarity: float):
    """Whether as few bits of word_marks differ as the edits allowed turn: of e edits, with d words more in one line, d at least turn one bit only."""

    def worth(x: Column, y: Column) -> Column:
        turned = sum((F.bit_count(x[f"m{i}"].bitwiseXOR(y[f"m{i}"])) for i in range(1, MARKS)), F.bit_count(x["m0"].bitwiseXOR(y["m0"])))
        edits = F.floor(F.lit(1 - similarity) * F.greatest(x["words"], y["words"]) + 1e-9)
        return turned <= 2 * edits - F.abs(x["words"] - y["words"])

    return worth


def word_string(codes: Column) -> Column:
    """A string with one character for each word."""
    digits = F.concat(F.lit("000"), F.array_join(F.transform(codes, lambda x: F.hex(x + 0x10000)), "000"))
    return F.decode(F.unhex(digits), "UTF-32")


def coded_lines(docs: DataFrame, classes: DataFrame, items: DataFrame) -> DataFrame:
    """(item, codes) of some classes, read again at their first occurrence."""
    spots = written(attach(classes.select(F.col("k1").alias("item"), "first.doc_id", "first.line_no"), items, ["item"], "inner"))
    texts = attach(raw_lines(docs), spots, ["doc_id", "line_no"], "inner", row_bytes=24).select("item", word_keys(F.col("line")).alias("line"))
    # Rows may repeat a doc_id with another text. As an equality this would be a key of the join, made of every line before it.
    found = texts.filter(F.array_contains(F.array(F.xxhash64("line")), F.col("item")))
    unnamed = raw_lines(docs.filter("doc_id IS NULL"), word_keys).select(F.xxhash64("line").alias("item"), "line")
    both = found.unionByName(attach(unnamed, items, ["item"], "left_semi"))
    return both.select("item", word_codes(F.col("line")).alias("codes")).dropDuplicates(["item"])


def _compared(docs: DataFrame, classes: DataFrame, shared: DataFrame, similarity: float):
    """From items: what verifies their pairs by edit similarity over words (1 - edits / words of the longer line), and their larger buckets with their marks."""
    most = f"cast(floor({1 - similarity:.6f} * greatest(length(code_a), length(code_b)) + 1e-9) as int)"

    def prepare(items: DataFrame):
        lines = written(coded_lines(docs, classes, items))

        def verify(pairs: DataFrame) -> DataFrame:
            paired = written(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct())
            coded = attach(lines, paired, ["item"], "left_semi").select("item", word_string(F.col("codes")).alias("code"))
            a = coded.select(F.col("item").alias("a"), F.col("code").alias("code_a"))
            b = coded.select(F.col("item").alias("b"), F.col("code").alias("code_b"))
            return pairs.join(b, "b").join(a, "a").filter(f"levenshtein(code_a, code_b, {most}) >= 0").select("a", "b")

        def larger(some: DataFrame) -> DataFrame:
            marks = word_marks(attach(lines, some, ["item"], "left_semi"))
            return shared.filter(F.col("n") > WHOLE).select("bucket", "item").join(marks, "item")

        return verify, larger

    return prepare


def line_classes(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, line_no, first_doc, first_line) of every line that says something and isn't its group's only one: the occurrence that
    stays for its group.

    Lines of least_words words or more are grouped with those that are alike, others with equal ones. Similarity is 0.8 or above: below
    that, blocks need not be shared.
    """
    if similarity < 0.8:
        raise ValueError("similarity must be 0.8 at least")
    lines = written(line_table(docs, least_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "line_no")).alias("first")
    classes = written(lines.groupBy("k1", "k2").agg(first, F.count("*").alias("n"), F.first("words").alias("words"), F.first("keys").alias("keys")))
    items = classes.filter("size(keys) > 0").select(F.col("k1").alias("item"), "words", "keys")
    shared = written(met(items, F.col("keys"), ("words",)))
    alike = lambda x, y: F.abs(x - y) <= F.floor(F.lit(1 - similarity) * F.greatest(x, y) + 1e-9)
    groups = grouped_by_rarity(shared, "words", alike, _compared(docs, classes, shared, similarity), may_be_alike(similarity))
    merged = attach(classes.select("k1", "k2", "n", "first"), groups.withColumnRenamed("node", "k1"), ["k1"], "inner")
    firsts = merged.groupBy("component").agg(F.min("first").alias("stays"))
    fuzzy = written(merged.join(firsts, "component").select("k1", "k2", "n", "first", "stays"))
    # A class with one line that stays has nothing to tell its lines.
    equal = classes.filter("n > 1").join(fuzzy, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("first").alias("stays"))
    telling = fuzzy.filter("n > 1 OR stays <> first").select("k1", "k2", "stays").unionByName(equal)
    return lines.join(telling, ["k1", "k2"]).select("doc_id", "line_no", F.col("stays.doc_id").alias("first_doc"), F.col("stays.line_no").alias("first_line"))


def deduplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows and columns of docs, with `text` less the lines of which another occurrence stays; n_lines, n_removed (int) are added.

    Lines without a letter or digit always stay. Null texts stay null, with no lines; empty texts have one, which stays. Rows with a
    null doc_id stay as they are; a line stays in them alone only if no row with a doc_id has it or one like it. Rows that repeat a doc_id count as one document: line numbers that go, go from each. Columns of docs
    called n_lines or n_removed are replaced; all others, of any name, stay as they are.
    """
    row_id, gone = fresh(docs, "row_id"), fresh(docs, "gone")
    found = line_classes(docs, similarity, least_words).filter("doc_id IS NOT NULL AND (first_doc IS NULL OR doc_id <> first_doc OR line_no <> first_line)")
    numbers = written(found.groupBy(F.col("doc_id").alias(row_id)).agg(F.sort_array(F.collect_set("line_no")).alias(gone)))
    size = numbers.agg(F.sum(F.size(gone) * 4 + 24).alias("b")).first()["b"] or 0
    rows = docs.withColumn(row_id, F.col("doc_id").cast("long"))
    joined = attach(rows, numbers, [row_id], "left", row_bytes=max(1, -(-size // max(1, numbers.count()))))
    lines = F.split("text", "\n", -1)
    # Stretches between the lines that go: linear in the lines of a text.
    starts = F.concat(F.array(F.lit(1)), F.transform(gone, lambda i: i + 2))
    ends = F.concat(gone, F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s, F.greatest(e - s + 1, F.lit(0))))), "\n")
    count = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    n_removed = F.size(F.filter(gone, lambda i: i < count))
    out = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept), "n_lines": count, "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(n_removed)}
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*(out["text"].alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names), out["n_lines"].alias("n_lines"), out["n_removed"].alias("n_removed"))
