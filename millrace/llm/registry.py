"""The queries of this subpackage. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, fill_middle, kneser_ney, languages, licenses, line_dedup, mixing, near_dedup, packing, quality, sharding, spotsigs, substring_dedup
from .common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many words repeat from smaller documents, and the digest of what is kept."""
    return substring_dedup.deduplicate_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the licenses that it carries, the best of them, and where that stands."""
    found = licenses.scan_licenses(documents(spark, sf_dir))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["coverage"], m["end"] - m["start"], -m["start"], m["license"].alias("license"), m["start"].alias("start"), m["end"].alias("end"))))
    found = found.withColumn("best", best)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", "n_words", F.size("matches").alias("n_matches"), names.alias("licenses"), F.col("best.license").alias("license"), F.col("best.coverage").alias("coverage"), F.col("best.start").alias("start_word"), F.col("best.end").alias("end_word"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return spotsigs.fingerprint_edits(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and the digest of what stays."""
    out = line_dedup.deduplicate_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many of its words the mix takes."""
    return mixing.mixed_documents(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and place, with sizes near equal and equal texts together."""
    return sharding.shard(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on four-word shingles."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=4)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression figures and verdict of every document."""
    return quality.judge_quality(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document: its length bucket, batch and slot."""
    return packing.pack(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from a model of those that are not held out."""
    docs = documents(spark, sf_dir)
    model = languages.train(docs.filter(languages.remainder(F.col("doc_id")) != 0))
    found = languages.identify_languages(docs, model)
    return found.select("doc_id", (languages.remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the form of its fill-in-the-middle text, where it is cut, and digests of it and of the text restored from it."""
    out = fill_middle.fill_in_middle(documents(spark, sf_dir))
    back = F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, after damage: its faults, its cheapest edits and the digest of the repaired text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_reports(rows, conversations.damaged(rows))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its log10 probability under the n-gram model of the documents that are not held out, and under single words."""
    docs = documents(spark, sf_dir)
    held_out = kneser_ney.remainder(F.col("doc_id")) == 0
    model = kneser_ney.train(docs.filter(~held_out))
    return kneser_ney.score_texts(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lm_scoring": op13_lm_scoring,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    # By code points and not by tokens: the cuts are where the first characters of tokens stand.
    "op11_fill_in_middle": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        chars AS (SELECT r, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM texts WHERE text <> ''),
        begun AS (SELECT r, i, CASE WHEN regexp_matches(c, '[A-Za-z]') AND lag(regexp_matches(c, '[A-Za-z]'), 1, false) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS first FROM chars),
        numbered AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS token FROM begun),
        counted AS (SELECT texts.*, coalesce((SELECT max(token) FROM numbered WHERE numbered.r = texts.r), 0)::BIGINT AS n FROM texts),
        drawn AS (
            SELECT r, doc_id, text, n, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1)::UBIGINT AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1)::UBIGINT AS y,
                text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 90 AS plain,
                ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 20 AS spm
            FROM counted),
        ends AS (
            SELECT drawn.r, count(i) FILTER (WHERE token <= least(x, y)) AS a, count(i) FILTER (WHERE token <= greatest(x, y)) AS b
            FROM drawn LEFT JOIN numbered ON numbered.r = drawn.r GROUP BY drawn.r),
        made AS (
            SELECT doc_id, text, n, plain, spm, a, b, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s
            FROM drawn JOIN ends ON ends.r = drawn.r)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
            sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM made""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
