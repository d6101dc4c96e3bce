"""Fill-in-the-middle: texts are cut into tokens and their middle moved behind the suffix, by DuckDB inside mapInArrow.

Each Arrow batch is registered as a view and rewritten by one SQL statement, so that no Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the three parts, and what a token is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: A registered batch has so many bytes of text at most, but for a single longer text: its token lists take about 20 times that.
PIECE_BYTES = 4 << 20

#: id: decimal doc_id or ''; h1 to h4: four numbers of its hash.
STATEMENT = f"""
WITH hashed AS (SELECT place, text, sha256('{{seed}}:' || id) AS h FROM batch),
drawn AS (
    SELECT place, text, regexp_extract_all(text, '{TOKEN}') AS tokens,
        ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
    FROM hashed),
cut AS (
    SELECT place, text, tokens, len(tokens)::BIGINT AS n,
        least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1))::BIGINT AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1))::BIGINT AS b,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {{fim}} THEN 'plain'
            WHEN h4 % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT place, text, n, form, array_to_string(list_slice(tokens, 1, a), '') AS prefix,
        array_to_string(list_slice(tokens, a + 1, b), '') AS middle, array_to_string(list_slice(tokens, b + 1, n), '') AS suffix
    FROM cut),
made AS (
    SELECT place, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM parts)
SELECT n, form, prefix_chars, middle_chars, output, sha256(output) AS output_sha256 FROM made ORDER BY place
"""
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch (id, text), PIECE_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + PIECE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _rewrite(statement: str):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1}) as engine:
            for batch in batches:
                for piece in pieces(batch):
                    rows = pa.table({"place": pa.array(np.arange(piece.num_rows)), "id": piece.column(0), "text": piece.column(1)})
                    engine.register("batch", rows)
                    made = engine.sql(statement).to_arrow_table().combine_chunks()
                    engine.unregister("batch")
                    yield pa.RecordBatch.from_arrays([piece.column(2), *(c.chunk(0) for c in made.columns)], names=["doc_id", *made.column_names])

    return rewrite


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (tokens), form (psm, spm or plain), prefix_chars, middle_chars, output, output_sha256 of every row of docs.

    The cuts and the form depend on seed and doc_id alone, so that reruns and retries agree; rows with one doc_id have the same draws. A null
    text counts as empty, a null doc_id as the empty id. Empty texts and texts that have a mark stay plain. Other columns of docs are left
    out. No shuffle; a task holds the tokens of PIECE_BYTES of text, or of one longer text.
    """
    statement = STATEMENT.format(seed=int(seed), fim=int(fim_percent), spm=int(spm_percent))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(ident.alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_rewrite(statement), f"doc_id {kind}, {RESULT}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. As no text of psm or spm has a mark, its marks are the three that were put in."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
