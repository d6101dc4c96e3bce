"""Decision tables and mapping rules, compiled to Columns or to joins with reference tables.

Order is priority: the first row or entry that matches wins. Small tables become CASE chains inside the row's own stage; reference
tables become equi-joins on de-duplicated keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import OPS, blank, casefold, group_number, java_regex, normalize, or_blank

Resolve = Callable[[str], Column | None]
#: Reference rows up to which a contains-map is compiled into a CASE chain.
CHAIN_ROWS = 256
#: Entries up to which a contains-map tries all of them on a source, and the lengths of the runs by which more are found.
FEW_ENTRIES, GRAMS = 1000, (3, 8, 16)


def source_of(spec: Mapping, resolve: Resolve) -> Column:
    """The source path's text, or the fallback's where that is '' (white space doesn't count as empty)."""
    first = or_blank(resolve(spec["source"])) if resolve(spec["source"]) is not None else F.lit("")
    if not spec.get("fallback_source"):
        return first
    second = resolve(spec["fallback_source"])
    return F.when(first != "", first).otherwise(or_blank(second) if second is not None else F.lit(""))


def table_names(table: Mapping) -> list[str]:
    """What a table sets, in order."""
    return list(table.get("names") or dict.fromkeys(k for row in table["rows"] for k in row["set"]))


def decision_table(table: Mapping, resolve: Resolve) -> tuple[Column, Column]:
    """(assignments, missed): a struct of the table's `set` columns, and whether no row matched.

    table: columns (source, op, normalize), rows (when: one needle for each column, '*' for any; set: values), on_no_match (action:
    default with values, empty, error or warn). Rows of another length than the columns are skipped.
    """
    names = table_names(table)
    sources = [normalize(source_of(c, resolve), c.get("normalize", [])) for c in table["columns"]]
    chain = None
    hit = F.lit(False)
    for row in table["rows"]:
        if len(row["when"]) != len(sources):
            continue
        tests = [OPS[c.get("op", "equals")](s, n) for c, s, n in zip(table["columns"], sources, row["when"], strict=True) if n != "*"]
        test = F.lit(True)
        for t in tests:
            test = test & t
        values = F.struct(*[F.lit(str(row["set"].get(n, ""))).alias(n) for n in names])
        chain = F.when(test, values) if chain is None else chain.when(test, values)
        hit = hit | test
    miss = table.get("on_no_match", {})
    default = miss.get("values", {}) if miss.get("action") == "default" else {}
    nothing = F.struct(*[F.lit(str(default.get(n, ""))).alias(n) for n in names])
    missed = ~hit if miss.get("action", "warn") in ("error", "warn") else F.lit(False)
    return nothing if chain is None else chain.otherwise(nothing), missed


def folding(rule: Mapping) -> Callable[[Column], Column]:
    """How texts are made ready to compare: as they are, or without case if the rule says so."""
    return casefold if rule.get("case", "sensitive") == "insensitive" else lambda c: c


def keyword_map(rule: Mapping, resolve: Resolve) -> Column:
    """The value of the first entry whose keyword is in the source; null if none. An empty keyword matches all."""
    source = normalize(source_of(rule, resolve), rule.get("normalize", []))
    fold = folding(rule)
    out = F.lit(None).cast("string")
    for entry in reversed(rule["map"]):
        out = F.when(F.contains(fold(source), fold(F.lit(entry["contains"]))), F.lit(str(entry["value"]))).otherwise(out)
    return out


def value_map(rule: Mapping, resolve: Resolve) -> Column:
    """The value of the first entry that equals the source; null if none."""
    source = normalize(source_of(rule, resolve), rule.get("normalize", []))
    fold = folding(rule)
    out = F.lit(None).cast("string")
    for entry in reversed(rule["map"]):
        out = F.when(fold(source) == fold(F.lit(str(entry["equals"]))), F.lit(str(entry["value"]))).otherwise(out)
    return out


def regex_problem(rule: Mapping) -> str:
    """Why a pattern or its group can't be used; '' if they can."""
    try:
        group_number(rule["pattern"], rule.get("group", 0))
    except (re.error, IndexError, KeyError, ValueError) as e:
        return str(e) or type(e).__name__
    return ""


def regex_extract(rule: Mapping, resolve: Resolve) -> Column:
    """A group of the first match, '' if the group took no part; null if nothing matches, or if the pattern is wrong."""
    if regex_problem(rule):
        return F.lit(None).cast("string")
    source, pattern = normalize(source_of(rule, resolve), rule.get("normalize", [])), rule["pattern"]
    java = java_regex(pattern)
    return F.when(source.rlike(java), F.regexp_extract(source, java, group_number(pattern, rule.get("group", 0))))


def fixed(rule: Mapping, resolve: Resolve) -> Column:
    return F.lit(str(rule["value"]))


COLUMN_RULES: dict[str, Callable[[Mapping, Resolve], Column]] = {"keyword_map": keyword_map, "value_map": value_map, "regex_extract": regex_extract, "fixed": fixed}


def on_miss(value: Column, rule: Mapping) -> tuple[Column, Column]:
    """(value, severity of the issue or null) after on_no_match: error, warn (default), default or empty."""
    miss = rule.get("on_no_match", {"action": "warn"})
    action = miss.get("action", "warn")
    if rule.get("kind") == "regex_extract" and regex_problem(rule):
        action = "error"
    filled = F.coalesce(value, F.lit(str(miss.get("value", "")) if action == "default" else ""))
    level = F.when(value.isNull(), F.lit(action)) if action in ("error", "warn") else F.lit(None).cast("string")
    return filled, level


def lookup(rows: DataFrame, reference: DataFrame, key: Column, key_column: str, returns: list[str], name: str, order: str = "_ord") -> DataFrame:
    """Adds struct `name` with the `returns` columns of the first reference row of that key; '' in all on a miss, which `{name}_missed` tells.

    The key is compared exactly; a blank key never matches. The reference is reduced to one row a key before the join.
    """
    first = reference.filter(F.coalesce(F.col(key_column), F.lit("")) != "").groupBy(F.col(key_column).alias("_k")).agg(F.min_by(F.struct(*returns), order).alias("_v"))
    joined = rows.withColumn("_key", key).join(first, F.col("_key") == F.col("_k"), "left")
    values = F.struct(*[F.coalesce(F.col("_v")[c].cast("string"), F.lit("")).alias(c) for c in returns])
    return joined.withColumn(name, values).withColumn(f"{name}_missed", F.col("_v").isNull()).drop("_key", "_k", "_v")


def csv_choice(rows: DataFrame, reference: DataFrame, key: Column, filter_column: str, value_column: str, name: str, order: str = "_ord") -> DataFrame:
    """Adds `name`: the one value that a key has in the reference, '' if it has none or several; `{name}_count` tells how many."""
    firsts = reference.filter(~blank(F.col(value_column))).groupBy(F.col(filter_column).alias("_k"), F.col(value_column).alias("_v")).agg(F.min(order).alias("_o"))
    choices = firsts.groupBy("_k").agg(F.count("*").alias("_n"), F.min_by("_v", "_o").alias("_v"))
    joined = rows.withColumn("_key", key).join(choices, F.col("_key") == F.col("_k"), "left")
    count = F.coalesce(F.col("_n"), F.lit(0))
    return joined.withColumn(name, F.when(count == 1, F.col("_v")).otherwise(F.lit(""))).withColumn(f"{name}_count", count).drop("_key", "_k", "_v", "_n")


def field_choices(reference: DataFrame, filter_column: str, value_column: str, order: str = "_ord") -> DataFrame:
    """(filter_column, choices): the distinct non-blank values of each key in file order, where there are two or more."""
    firsts = reference.filter(~blank(F.col(value_column))).groupBy(filter_column, value_column).agg(F.min(order).alias("_o"))
    lists = firsts.groupBy(filter_column).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value_column).alias("v")))).alias("c"))
    return lists.select(filter_column, F.transform("c", lambda x: x["v"]).alias("choices")).filter(F.size("choices") > 1)


def csv_map(rows: DataFrame, entries: list[tuple[str, str]], source: Column, name: str, longest_first: bool = False, equal: bool = False, insensitive: bool = True) -> DataFrame:
    """Adds `name`: the value of the first entry (needle, value) that the source holds, by file order or the longest first; null if none.

    Blank needles are skipped. Entries stand in the rule book, which bounds them; beyond CHAIN_ROWS of them, they are matched as a table.
    """
    ordered = [(n, v) for n, v in entries if n.strip()]
    if len(ordered) > CHAIN_ROWS:
        table = rows.sparkSession.createDataFrame([(i, n, v) for i, (n, v) in enumerate(ordered)], "_ord int, needle string, value string")
        return csv_map_table(rows, table, source, name, "needle", "value", longest_first=longest_first, insensitive=insensitive, equal=equal)
    if longest_first:
        ordered.sort(key=lambda e: -len(e[0]))
    fold = casefold if insensitive else lambda c: c
    out = F.lit(None).cast("string")
    for needle, value in reversed(ordered):
        test = fold(source) == fold(F.lit(needle)) if equal else F.contains(fold(source), fold(F.lit(needle)))
        out = F.when(test, F.lit(value)).otherwise(out)
    return rows.withColumn(name, out)


def csv_map_table(rows: DataFrame, reference: DataFrame, source: Column, name: str, key_column: str, value_column: str, filter_column: str | None = None, filter_value: str = "", mode_column: str | None = None, longest_first: bool = False, insensitive: bool = False, equal: bool = False, order: str = "_ord") -> DataFrame:
    """Adds `name`: the value of the first reference row whose needle the source holds, or equals where mode_column says `equals`; null
    if none. filter_column keeps the rows of one customer.

    Up to FEW_ENTRIES rows, which are counted, make one array that every distinct source is matched with; more are found by their grams.
    """
    mine = reference if filter_column is None else reference.filter(F.coalesce(F.col(filter_column), F.lit("")) == filter_value)
    fold = casefold if insensitive else lambda c: c
    needle = F.coalesce(F.col(key_column), F.lit(""))
    whole = F.lit(equal) if mode_column is None else F.col(mode_column) == "equals"
    rank = -F.length(needle) if longest_first else F.lit(0)
    entry = F.struct(rank.alias("r"), F.col(order).cast("long").alias("o"), fold(needle).alias("n"), F.coalesce(whole, F.lit(False)).alias("w"), F.coalesce(value_column, F.lit("")).alias("v"))
    entries = mine.filter(needle != "").select(entry.alias("e"))
    keyed = rows.withColumn("_src", source)
    sources = keyed.select(F.col("_src").alias("_one_src")).distinct().withColumn("_hay", fold(F.col("_one_src")))
    if entries.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES:
        table = entries.agg(F.array_sort(F.collect_list("e")).alias("_entries"))
        hits = F.filter("_entries", lambda e: F.when(e["w"], F.col("_hay") == e["n"]).otherwise(F.contains(F.col("_hay"), e["n"])))
        found = sources.crossJoin(F.broadcast(table)).select("_one_src", F.get(hits, F.lit(0))["v"].alias(name))
    else:
        found = first_contained(sources, entries).select("_one_src", F.col("_best.v").alias(name))
    return keyed.join(found, keyed["_src"].eqNullSafe(found["_one_src"]), "left").drop("_src", "_one_src")


def grams(text: Column, n: int) -> Column:
    """The hashes of the distinct runs of n characters of a text; an empty array if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.length(text) - n), lambda i: F.xxhash64(F.substring(text, i + 1, F.lit(n))))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<long>"))


def first_contained(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(_one_src, _best): the least entry of each source that holds its needle, or equals it; sources without one are left out.

    sources: _one_src, _hay (the text that is searched), both distinct. entries: e, a struct that sorts as entries are tried, with n (a needle, not
    empty) and w (equality). Of equal needles the least entry alone is looked for. A needle is filed under one of its grams, the one that the fewest needles
    have; grams are runs of the greatest length of GRAMS that its needle has, so that they tell long needles apart however many there are. Sources
    come by their grams, and what meets is verified, so that equal hashes do no harm. Needles below the least length, of which alphabets have few, are tried
    on every source up to FEW_ENTRIES, and found as runs beyond. Joins are by merging, as neither side is known to be small.
    """
    entries = entries.groupBy("e.n", "e.w").agg(F.min("e").alias("e")).select("e")
    sources = sources.filter("_hay IS NOT NULL").withColumn("_id", F.xxhash64("_hay"))
    parts, size = entries.filter("NOT e.w"), F.length("e.n")
    short = parts.filter(size < GRAMS[0])
    few = short.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES
    sizes = GRAMS if few else (*range(1, GRAMS[0]), *GRAMS)
    longest = lambda n, more: (size >= n) & (size < more) if more else size >= n
    own = F.coalesce(*(F.when(longest(n, more), grams(F.col("e.n"), n)) for n, more in zip(sizes, (*sizes[1:], None))))
    runs = parts.filter(size >= sizes[0]).select("e", F.explode(own).alias("_gram"))
    often = runs.groupBy("_gram").agg(F.count("*").alias("_n"))
    filed = runs.join(often.hint("merge"), "_gram").groupBy("e").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    held = sources.select("_id", F.explode(F.concat(*(grams(F.col("_hay"), n) for n in sizes))).alias("_gram"))
    met = held.join(filed.hint("merge"), "_gram").select("_id", "e")
    texts = sources.select("_id", "_one_src", "_hay")
    found = met.join(texts.hint("merge"), "_id").filter(F.contains("_hay", F.col("e.n"))).select("_one_src", "e")
    same = texts.join(entries.filter("e.w").hint("merge"), F.col("_hay") == F.col("e.n")).select("_one_src", "e")
    found = found.unionByName(same)
    if few:
        table = short.agg(F.array_sort(F.collect_list("e")).alias("_entries"))
        hit = F.get(F.filter("_entries", lambda e: F.contains(F.col("_hay"), e["n"])), F.lit(0))
        tried = texts.crossJoin(F.broadcast(table)).select("_one_src", hit.alias("e"))
        found = found.unionByName(tried.filter("e IS NOT NULL"))
    return found.groupBy("_one_src").agg(F.min("e").alias("_best"))


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
