"""Writers: payloads, audits, batches, reference tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.review import payload_chunks


def payload_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def sorted_json(fields: Mapping[str, Column]) -> Column:
    """Texts as one JSON object with its keys in order, `: ` and `, ` between parts, and letters outside ASCII as they are; null texts are null."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1), F.lit("null"))
    parts = [F.concat(quoted(F.lit(k)), F.lit(": "), F.when(c.isNull(), "null").otherwise(quoted(c))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def write_payloads(rows: DataFrame, path: str, columns: list[str], order: list, max_rows: int, by: list[str]) -> None:
    """Payload slices as JSON lines, each with its digest."""
    out = payload_chunks(rows, columns, order, max_rows, by)
    out.withColumn("digest", payload_digest(F.col("rows"))).write.mode("overwrite").json(path)


def append_audit(attempts: DataFrame, path: str, at: str = "at", key: str = "BSTKD") -> None:
    """One line for each attempt, by month; of the order, only its key."""
    kept = [c for c in ("batch_id", at, "status", "http_status", "digest", key) if c in attempts.columns]
    attempts.select(*kept, F.date_format(at, "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").json(path)


def save_batch(rows: DataFrame, path: str) -> None:
    """Spark's committer makes the replacement visible as a whole."""
    rows.write.mode("overwrite").parquet(path)


def new_responses(responses: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What of responses (key, payload, stop_reason, others) is to be stored: not cut off, not stored yet, and one of each key."""
    whole = responses.filter("stop_reason IS NULL OR stop_reason <> 'max_tokens'")
    if stored is not None:
        whole = whole.join(stored.select("key").distinct(), "key", "left_anti")
    rest = [c for c in whole.columns if c != "key"]
    return whole.groupBy("key").agg(F.min(F.struct("payload", *(c for c in rest if c != "payload"))).alias("_r")).select("key", *(F.col("_r")[c].alias(c) for c in rest))


def save_responses(responses: DataFrame, path: str) -> None:
    """Appends responses under their keys. A key that is stored already stays as it is, so that a second save changes nothing; the store is cut by the
    first two digits of its keys."""
    spark = responses.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    new_responses(responses, stored).withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


class Refused(ValueError):
    """A replacement that was not made, and why."""


def replacement_problems(rows: DataFrame, key: str, limits: Mapping[str, int], scope: str | None = None) -> DataFrame:
    """(place, problem, value) of rows (place, key and value columns) that a table must not get: no_key, other_scope (not of the customer whose rows are
    edited), too_long:<column>, duplicate (a key that an earlier row has). Rows without any text are no rows."""
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    columns = [c for c in rows.columns if c != "place"]
    rows = rows.select("place", *(text(c).alias(c) for c in columns)).filter(F.concat(*columns) != "")
    told = lambda test, problem, c: F.when(test, F.struct(F.lit(problem).alias("problem"), F.col(c).alias("value")))
    tests = [told(F.col(key) == "", "no_key", key), told((F.col(key) != "") & (F.col(key) != scope), "other_scope", key) if scope is not None else None]
    tests += [told(F.length(c) > most, f"too_long:{c}", c) for c, most in limits.items()]
    found = rows.select("place", F.explode(F.filter(F.array(*(t for t in tests if t is not None)), lambda x: x.isNotNull())).alias("_x")).select("place", "_x.*")
    full = rows.filter(F.concat(*(c for c in columns if c != key)) != "")
    again = full.filter(F.col(key) != "").groupBy(key).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    twice = full.join(again, key).filter("place > _first").select("place", F.lit("duplicate").alias("problem"), F.col(key).alias("value"))
    return found.unionByName(twice)


def replace_table(rows: DataFrame, path: str, key: str, limits: Mapping[str, int], scope: str | None = None) -> None:
    """Replaces the table at path (Parquet), or with scope the rows of that key, by rows (place, key and value columns): all of them or, if one has a problem,
    none. Rows without a value delete.

    The new table is written beside the old one, and takes its place by renames when it is whole; a failure before leaves the old one.
    """
    spark = rows.sparkSession
    told = replacement_problems(rows, key, limits, scope).orderBy("place", "problem").limit(5).collect()
    if told:
        raise Refused("; ".join(f"row {r.place}: {r.problem} {r.value}" for r in told))
    columns = [c for c in rows.columns if c != "place"]
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    new = rows.select(*map(text, columns)).filter(F.concat(*(c for c in columns if c != key)) != "")
    if scope is not None:
        new = spark.read.parquet(path).filter(F.col(key) != scope).unionByName(new)
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    new.write.parquet(staged)
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    if not files.rename(at(staged), at(path)):
        files.rename(at(old), at(path))
        raise Refused(f"{path} could not be replaced")
    files.delete(at(old), True)


def save_reference(table: DataFrame, path: str, order: str = "_ord") -> None:
    """A reference table as one CSV file in its order; such tables are small by nature."""
    table.coalesce(1).sortWithinPartitions(order).drop(order).write.mode("overwrite").csv(path, header=True)


def kept_backups(backups: DataFrame, name: str, keep: int) -> DataFrame:
    """The newest backups of each table; all if keep is 0 or less."""
    from pyspark.sql import Window

    if keep <= 0:
        return backups
    return backups.withColumn("_rn", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("file")))).filter(F.col("_rn") <= keep).drop("_rn")
