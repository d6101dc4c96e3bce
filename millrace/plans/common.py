"""Registration of queries with their SQL twins, and the tables as orders, lines and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, names: str, *values: tuple) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(list(values), names)


#: All columns of lineitem, so that ties are between equal rows only.
TIE = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
TIE_SQL = ", ".join(TIE)


def value(c: Column) -> Column:
    return F.struct(c.cast("string").alias("value"))


def decimal(c: Column, digits: int = 2) -> Column:
    return F.bround(c.cast("decimal(38,6)"), digits).cast(f"decimal(38,{digits})").cast("string")
