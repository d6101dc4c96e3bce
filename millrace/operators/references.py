"""Reference-table operators: overlay, scoped replacement, import diff, catalog. Tables carry their order in `_ord`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, pad_left


def overlay(master: DataFrame, manual: DataFrame, keys: tuple[str, str] = ("kunnr", "zbrand")) -> DataFrame:
    """A master table with manual suppress, override and add rows applied, in order, with `_source` (sap or manual) and a new `_ord`.

    Suppressed pairs go. Overrides replace non-blank cells in place; of several, the last wins. Added rows stand after the last
    remaining row of their customer; customers without one go last. Rows without a customer are skipped.
    """
    who, _ = keys
    values = [c for c in master.columns if c not in (*keys, "_ord")]
    named = manual.filter(~blank(F.col(who)))
    gone = named.filter("action = 'suppress'").select(*keys).distinct()
    change = named.filter("action = 'override'").groupBy(*keys).agg(F.max_by(F.struct(*values), "_ord").alias("_new"))
    kept = master.join(gone, list(keys), "left_anti").join(change, list(keys), "left")
    merged = [F.when(F.col("_new").isNotNull() & ~blank(F.col("_new")[c]), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in values]
    kept = kept.select(*keys, *merged, "_ord", F.when(F.col("_new").isNotNull(), "manual").otherwise("sap").alias("_source"))
    ends = kept.groupBy(who).agg(F.max("_ord").alias("_end"))
    adds = named.filter("action = 'add'").select(*keys, *values, "_ord").join(ends, who, "left")
    first = F.min("_ord").over(Window.partitionBy(who))
    adds = adds.select(*keys, *values, F.lit("manual").alias("_source"), F.when(F.col("_end").isNull(), 1).otherwise(0).alias("_a"), F.coalesce("_end", first).alias("_b"), F.lit(1).alias("_c"), F.col("_ord").alias("_d"))
    rows = kept.select(*keys, *values, "_source", F.lit(0).alias("_a"), F.col("_ord").alias("_b"), F.lit(0).alias("_c"), F.lit(0).alias("_d")).unionByName(adds)
    return rows.withColumn("_ord", F.struct("_a", "_b", "_c", "_d")).drop("_a", "_b", "_c", "_d")


def replace_scope(table: DataFrame, new: DataFrame, key: str, value: str | None) -> DataFrame:
    """One key's block replaced by new rows at its first position (at the end if it had none); without a value, everything."""
    if value is None:
        return new
    spot = table.filter(F.col(key) == value).agg(F.min("_ord").alias("_at")).crossJoin(table.agg(F.max("_ord").alias("_last")))  # one row each
    fresh = new.crossJoin(F.broadcast(spot)).select(*new.columns, F.coalesce("_at", F.col("_last") + 1).alias("_x"), F.lit(1).alias("_y"))
    kept = table.filter(F.col(key) != value).withColumn("_x", F.col("_ord")).withColumn("_y", F.lit(0))
    return kept.unionByName(fresh)


def import_diff(old: DataFrame, new: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """(change, key, value): added and removed keys and pairs, and keys whose label changed."""
    ko, kn = old.select(key).distinct(), new.select(key).distinct()
    po, pn = old.select(key, value).distinct(), new.select(key, value).distinct()
    none = F.lit(None).cast("string")
    part = lambda df, change, v=none: df.select(F.lit(change).alias("change"), F.col(key).cast("string").alias("key"), v.cast("string").alias("value"))
    a, b = old.groupBy(key).agg(F.min(label).alias("_a")), new.groupBy(key).agg(F.min(label).alias("_b"))
    return (
        part(kn.join(ko, key, "left_anti"), "customer_added")
        .unionByName(part(ko.join(kn, key, "left_anti"), "customer_removed"))
        .unionByName(part(pn.join(po, [key, value], "left_anti"), "pair_added", F.col(value)))
        .unionByName(part(po.join(pn, [key, value], "left_anti"), "pair_removed", F.col(value)))
        .unionByName(part(a.join(b, key).filter("_a <> _b"), "renamed", F.col("_b")))
    )


def manual_problems(master: DataFrame, manual: DataFrame, keys: tuple[str, str] = ("kunnr", "zbrand")) -> DataFrame:
    """(keys, action, problem): targets that don't exist, adds that do, repeats, missing notes."""
    on = list(keys)
    known = master.select(*on).distinct()
    lost = manual.filter("action IN ('override', 'suppress')").join(known, on, "left_anti").select(*on, "action", F.lit("no_target").alias("problem"))
    there = manual.filter("action = 'add'").join(known, on, "left_semi").select(*on, "action", F.lit("exists").alias("problem"))
    twice = manual.groupBy(*on, "action").agg(F.count("*").alias("n")).filter("n > 1").select(*on, "action", F.lit("repeated").alias("problem"))
    bare = manual.filter(blank(F.trim("note"))).select(*on, "action", F.lit("no_note").alias("problem"))
    return lost.unionByName(there).unionByName(twice).unionByName(bare)


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def too_long(table: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with a cell over its column's limit, and which."""
    over = F.filter(F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in limits.items()]), lambda x: x.isNotNull())
    return table.withColumn("too_long", over).filter(F.size("too_long") > 0)


def catalog(customers: DataFrame, brands: DataFrame, configured: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """kunnr, name, brand_count, manual_count, configured, ready of every customer. customers: kunnr, name1, _ord; brands: kunnr, zbrand."""
    names = customers.groupBy("kunnr").agg(F.min_by("name1", "_ord").alias("name"))
    count = lambda df, c: df.groupBy("kunnr").agg(F.count("*").alias(c))
    rows = names.join(count(brands, "brand_count"), "kunnr", "left").join(configured.select("kunnr", F.lit(True).alias("configured")).distinct(), "kunnr", "left")
    rows = rows.join(count(manual, "manual_count"), "kunnr", "left") if manual is not None else rows.withColumn("manual_count", F.lit(0))
    rows = rows.fillna(0, ["brand_count", "manual_count"]).fillna(False, ["configured"])
    return rows.withColumn("ready", F.col("configured") | (F.col("brand_count") > 0))


def catalog_page(rows: DataFrame, text: str = "", scope: str = "all", offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the catalog by zero-filled customer number."""
    if text:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains("kunnr", F.lit(text)))
    if scope != "all":
        rows = rows.filter(F.col("configured") == (scope == "configured"))
    return rows.orderBy(pad_left(F.col("kunnr"), 12), "kunnr").offset(offset).limit(max(1, min(500, limit)))


def registered_codes(master: DataFrame, manual: DataFrame, keys: tuple[str, str] = ("kunnr", "zbrand")) -> DataFrame:
    """The distinct pairs of keys after manual corrections: without suppressed ones, and with added ones. Corrections without a customer are none."""
    who, _ = keys
    named = manual.filter(~blank(F.col(who)))
    gone = named.filter("action = 'suppress'").select(*keys).distinct()
    return master.select(*keys).join(gone, list(keys), "left_anti").unionByName(named.filter("action = 'add'").select(*keys)).distinct()


def customer_catalog(master: DataFrame, manual: DataFrame, books: DataFrame, text: str = "", scope: str = "all", sort: str = "name") -> DataFrame:
    """Every customer of the brand table, sorted: kunnr, name, sap_name, code, brand_count, manual_count, configured, ready.

    master: kunnr, name1, _ord. manual: kunnr. books: customer_no, name, code. The name is the book's, else the first that the table has, else the number in
    brackets. text is looked for in name, sap_name, kunnr and code, without case; scope is all, configured (with a book) or unconfigured; sort is name, kunnr
    (as a number of twelve digits), or ready (those first, by name).
    """
    named = F.when(~blank(F.col("name1")), F.col("_ord"))
    rows = master.groupBy("kunnr").agg(F.coalesce(F.min_by("name1", named), F.lit("")).alias("sap_name"), F.count("*").alias("brand_count"))
    own = books.filter(~blank(F.col("customer_no"))).select(F.col("customer_no").alias("kunnr"), F.col("name").alias("_name"), "code")
    rows = rows.join(own, "kunnr", "left").join(manual.groupBy("kunnr").agg(F.count("*").alias("manual_count")), "kunnr", "left")
    rows = rows.withColumns({"code": F.coalesce("code", F.lit("")), "manual_count": F.coalesce("manual_count", F.lit(0))})
    name = F.when(~blank(F.col("_name")), F.col("_name")).when(F.col("sap_name") != "", F.col("sap_name")).otherwise(F.concat(F.lit("("), "kunnr", F.lit(")")))
    rows = rows.withColumns({"name": name, "configured": F.col("code") != ""}).withColumn("ready", F.col("configured") | (F.col("brand_count") > 0))
    if scope != "all":
        rows = rows.filter(F.col("configured") == (scope == "configured"))
    needle = text.strip().lower()
    if needle:
        test = F.lit(False)
        for c in ("name", "sap_name", "kunnr", "code"):
            test = test | F.contains(F.lower(c), F.lit(needle))
        rows = rows.filter(test)
    orders = {"kunnr": [pad_left(F.col("kunnr"), 12)], "ready": [~F.col("ready"), F.lower("name"), F.col("kunnr")], "name": [F.lower("name"), F.col("kunnr")]}
    return rows.select("kunnr", "name", "sap_name", "code", "brand_count", "manual_count", "configured", "ready").orderBy(*orders[sort])
