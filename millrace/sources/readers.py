"""Readers: documents, reference tables, rule books, templates, stored responses, audits, batches."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.review import stale_status
from .html import decode_html, html_text

KINDS = ("pdf", "htm", "html")
# Sections whose entries are replaced as a whole when rule books are merged.
ENTRIES = ("fields", "tables", "rules", "field_specs")
TEXT_CHARS_A_PAGE = 40


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filename, ext, pages, has_text, error of HTML files under a path (glob). What can't be read is an error row, not an exception."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = raw.select(name.alias("filename"), ext.alias("ext"), "content").withColumn("text", F.when(F.col("ext").isin("htm", "html"), html_text(decode_html("content"))))
    error = F.when(~F.col("ext").isin(*KINDS), F.concat(F.lit("unsupported: "), "ext")).when(F.col("ext") == "pdf", "no PDF reader")
    pages = F.when(F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))
    return rows.select("filename", "ext", pages.alias("pages"), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)).alias("has_text"), error.alias("error"))


def has_text_layer(pages) -> object:
    """A PDF has a text layer if its pages have 40 characters on average."""
    return F.coalesce(F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(p)) / F.size(pages) >= TEXT_CHARS_A_PAGE, F.lit(False))


def read_reference(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """A CSV reference table: every cell trimmed text, and the file's order as `_ord`. None if it is optional and absent.

    Reference tables are small files by nature; a file is read by one task, so its lines keep their order.
    """
    try:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").coalesce(1)
    except Exception as e:  # noqa: BLE001  Spark has no narrower one for a path that isn't there
        if optional and "PATH_NOT_FOUND" in str(e):
            return None
        raise
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns], F.monotonically_increasing_id().alias("_ord"))


def read_export(spark: SparkSession, path: str, required: tuple[str, ...] = ("kunnr", "zbrand")) -> DataFrame:
    """A brand export: table aliases (A~KUNNR) go from the names, names become lower case, rows without a key go."""
    df = read_reference(spark, path)
    df = df.toDF(*[c.rpartition("~")[2].lower() for c in df.columns])
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"{path} has no column {', '.join(lost)}")
    return df.filter(" AND ".join(f"{c} <> ''" for c in required))


def _leaves(book: Mapping, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """The paths of a book with their values. Entries of ENTRIES count as values, mappings though they are."""
    for key, value in book.items():
        at = (*path, key)
        inner = isinstance(value, Mapping) and value and not (len(at) == 2 and path[0] in ENTRIES)
        yield from _leaves(value, at) if inner else [(at, value)]


def merge_books(base: Mapping, own: Mapping) -> dict:
    """The values of both books by path, own ones winning: lists, and entries of ENTRIES, are replaced as a whole."""
    values = dict(_leaves(base))
    for at, value in _leaves(own):
        below = [p for p in values if p[: len(at)] == at and p != at]
        if below and isinstance(value, Mapping) and not value:
            continue
        for p in [*below, *(at[:n] for n in range(1, len(at)))]:
            values.pop(p, None)
        values[at] = value
    out: dict = {}
    for (*path, key), value in values.items():
        inner = out
        for step in path:
            inner = inner.setdefault(step, {})
        inner[key] = value
    return out


def load_book(texts: Mapping[str, str], name: str, seen: tuple[str, ...] = ()) -> dict:
    """A rule book with what it extends. texts: YAML text by name. own_fields lists the fields that the book itself declares."""
    if name in seen:
        raise ValueError(f"rule books extend each other: {' > '.join((*seen, name))}")
    own = yaml.safe_load(texts[name])
    if not isinstance(own, Mapping):
        raise ValueError(f"{name} must be a mapping")
    out: dict = {}
    for parent in own.get("extends", []):
        out = merge_books(out, load_book(texts, parent, (*seen, name)))
    out = merge_books(out, {k: v for k, v in own.items() if k != "extends"})
    return out | {"own_fields": list(own.get("fields", {}))}


def book_problems(book: Mapping) -> list[str]:
    """What a rule book gets wrong: unknown rules and kinds, expressions that don't compile, undeclared fields, formats."""
    from ..functions.expr import ExprError, check, lint, parse
    from ..functions.formats import FORMATS
    from ..operators.rules import COLUMN_RULES

    found = []
    for name in book.get("field_specs", {}):
        if name not in book.get("fields", {}):
            found.append(f"field {name} is not declared")
    for name, spec in book.get("fields", {}).items():
        if name not in book.get("field_specs", {}):
            found.append(f"field {name} has no specification")
        if spec.get("from") == "rule" and spec.get("rule") not in book.get("rules", {}):
            found.append(f"field {name}: no rule {spec.get('rule')}")
        if spec.get("format") and spec["format"] not in FORMATS:
            found.append(f"field {name}: unknown format {spec['format']}")
        if spec.get("from") == "expr":
            try:
                tree = parse(spec["expr"])
                check(tree)
                found += [f"field {name}: {w}" for w in lint(tree)]
            except ExprError as e:
                found.append(f"field {name}: {e}")
    for name, rule in book.get("rules", {}).items():
        if rule.get("kind") not in (*COLUMN_RULES, "lookup", "csv_map", "csv_choice"):
            found.append(f"rule {name}: unknown kind {rule.get('kind')}")
        if rule.get("kind") == "csv_choice" and rule.get("on_many") == "default":
            found.append(f"rule {name}: several choices can't have a default")
    for table in book.get("tables", []):
        for i, row in enumerate(table["rows"]):
            if len(row["when"]) != len(table["columns"]):
                found.append(f"table {table.get('name')}: row {i + 1} has {len(row['when'])} conditions, not {len(table['columns'])}")
    return found


def read_template(path: str) -> list[tuple[str, str]]:
    """(code, heading) of an xlsx template: headings in row 1, codes in row 2. A code twice, or none, is an error."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    grid: dict[str, dict[str, str]] = {}
    for cell in sheet.iter(f"{space}c"):
        at = cell.get("r", "")
        raw = cell.findtext(f"{space}v") or "".join(t.text or "" for t in cell.iter(f"{space}t"))
        grid.setdefault(at.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), {})[at.rstrip("0123456789")] = shared[int(raw)] if cell.get("t") == "s" else raw
    columns = [(code, grid.get("1", {}).get(c, "")) for c, code in grid.get("2", {}).items() if code]
    if not columns or len({c for c, _ in columns}) < len(columns):
        raise ValueError(f"{path} has no codes, or one twice")
    return columns


def response_key(sent: Column, kind: Column, version: Column, customer: Column, model: Column) -> Column:
    """The content address of a stored response: what was sent (null: nothing), and how it was read."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (sent, kind, version, customer, model)]
    return F.sha2(F.concat(parts[0], *(F.concat(F.lit("\0"), c) for c in parts[1:])), 256)


def response_name(customer: Column, file: Column, part: str = "") -> Column:
    """The name of a response that is kept by hand: customer, file (without its folder, odd characters as _), and part (outline, c0, c1, ...)."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_extract(file, "[^/]*$", 0), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.lower(customer), F.lit("__"), safe, F.lit(f"__{part}" if part else ""), F.lit(".json"))


def find_responses(requests: DataFrame, named: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (file_name, part_name, key, others) with payload and origin: file if a response of the whole file is kept by name, else part, else store, else
    null for both.

    named: name, payload, names once each. stored: key, payload. Each is an equi-join; requests stay as many as they are.
    """
    by = lambda df, on, name: df.select(F.col(on).alias(f"_{name}_on"), F.col("payload").alias(f"_{name}"))
    out = requests
    for name, df, on, at in (("file", named, "name", "file_name"), ("part", named, "name", "part_name"), ("store", stored, "key", "key")):
        out = out.join(by(df, on, name), F.col(at) == F.col(f"_{name}_on"), "left").drop(f"_{name}_on")
    origin = F.when(F.col("_file").isNotNull(), "file").when(F.col("_part").isNotNull(), "part").when(F.col("_store").isNotNull(), "store")
    return out.withColumns({"payload": F.coalesce("_file", "_part", "_store"), "origin": origin}).drop("_file", "_part", "_store")


def read_audit(spark: SparkSession, path: str, month: str) -> DataFrame:
    """Send attempts of a month (YYYY-MM)."""
    return spark.read.json(path).filter(F.col("month") == month)


def read_batches(spark: SparkSession, path: str, now: str, stale_minutes: int = 30) -> DataFrame:
    """Saved batches, with stale ones shown as FAILED; what is stored stays as it is."""
    df = spark.read.parquet(path)
    return df.withColumn("status", stale_status(F.col("status"), F.col("created_at"), F.lit(now).cast("timestamp"), stale_minutes))
