"""Packing into optimal length buckets, with DataFrame operations; the driver sees the histogram of lengths alone.

Texts are cut into pieces of `longest` tokens at most. Dynamic programming over the global histogram of piece lengths chooses the
bucket boundaries for which padding is least. Inside a bucket, pieces are shuffled, and batches of as many pieces as the token budget
holds, padding included, are formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, with_rank, written

BUCKETS = 8
LONGEST = 2048
BUDGET = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD.replace("\\x20", " "))), F.lit(0))


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Rising bucket lengths, `buckets` at most, for which the padding of pieces is least. counts[n]: pieces of length n; counts[0] has none.

    least[j] is the least padding of pieces up to length j with one more bucket each round, the last ending at j.
    """
    top = int(np.flatnonzero(counts).max(initial=0))
    if not top:
        return []
    n = np.cumsum(counts[: top + 1].astype(np.float64))
    tokens = np.cumsum(counts[: top + 1].astype(np.float64) * np.arange(top + 1))
    length = np.arange(top + 1)
    least, cut = length * n - tokens, []
    for _ in range(1, min(buckets, int((counts > 0).sum()))):
        better, at = least.copy(), np.zeros(top + 1, dtype=np.int64)
        for j in range(2, top + 1):
            padding = least[:j] + j * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            i = int(padding.argmin())
            if padding[i] < better[j]:
                better[j], at[j] = padding[i], i
        least = better
        cut.append(at)
    ends = [top]
    for at in reversed(cut):
        if at[ends[-1]]:
            ends.append(int(at[ends[-1]]))
    return ends[::-1]


def pieces(docs: DataFrame, longest: int, length: Column) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): each row's text in pieces of `longest` tokens; one of no tokens if it has none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("_n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("_n") / longest) - 1).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * longest
    return rows.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(longest), F.col("_n") - first).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, budget: int = BUDGET, seed: int = 9, length: Column | None = None) -> DataFrame:
    """Where each piece of each row's text goes: doc_id, piece (int, from 0), first_token (long), n_tokens (int), bucket (int, from 0),
    bucket_length (int), batch (long, gapless from 0 in each bucket), slot (int, gapless from 0 in each batch).

    Tokens are words, or what `length` counts (a column over docs). All batches of a bucket are full but its last. Rows whose text is
    null or empty have one piece without tokens, in no bucket (nulls). Rows that repeat a doc_id are packed each on their own; they may
    swap places. A null doc_id is a key like others. Extra columns are ignored. An empty table gives an empty one.
    """
    if budget < longest:
        raise ValueError("the budget must hold a piece")
    cut = written(pieces(docs, longest, word_count(F.col("text")) if length is None else length))
    counts = np.zeros(longest + 1, dtype=np.int64)
    for r in cut.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect():
        counts[r["n_tokens"]] = r["n"]
    ends = boundaries(counts, buckets)
    number = F.expr(" + ".join(["0", *(f"cast(n_tokens > {x} as int)" for x in ends[:-1])]))
    lengths = F.array(*map(F.lit, ends)) if ends else F.array(F.lit(1))
    rows = cut.filter("n_tokens > 0").withColumn("bucket", number.cast("int"))
    rows = rows.withColumn("bucket_length", F.element_at(lengths, F.col("bucket") + 1))
    ranked = with_rank(rows, "bucket", [F.xxhash64(F.lit(seed), "doc_id", "piece"), F.col("doc_id"), F.col("piece"), F.col("n_tokens")], "_rank")
    each = F.floor(F.lit(budget) / F.col("bucket_length"))
    placed = ranked.withColumn("batch", F.floor(F.col("_rank") / each)).withColumn("slot", (F.col("_rank") % each).cast("int"))
    names = ["doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_length", "batch", "slot"]
    none = cut.filter("n_tokens <= 0").select("doc_id", "piece", "first_token", "n_tokens", *(F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "int"), ("batch", "bigint"), ("slot", "int"))))
    return placed.select(*names).unionByName(none)
