"""Validation of rule books: what one book gets wrong, told on the driver as a book is one file, and what reference tables get wrong, as joins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ExprError, check, lint, parse, paths
from ..functions.formats import FORMATS
from ..functions.text import OPS, blank
from .engine import HEADER_KEYS, LINE_KEYS, SHIPMENT_KEYS
from .references import registered_codes
from .rules import COLUMN_RULES

# The words of rule books, and the chunk policy's keys.
SOURCES = ("const", "base", "doc", "table", "rule", "gen", "expr")
KINDS = (*COLUMN_RULES, "lookup", "csv_map", "csv_choice")
CHUNKING = ("enabled", "max_lines_per_chunk", "tokens_per_line", "safety_ratio", "continuation_lines", "header_context_lines")
ACTIONS = ("add", "override", "suppress")
Finding = tuple[int, str, str, str]


def chunk_policy(base: Mapping, own: Mapping | None = None) -> dict:
    """The chunk policy of a book, merged key by key with the base's; a key that neither has is an error."""
    found = {**base, **(own or {})}
    missing = [k for k in CHUNKING if k not in found]
    if missing:
        raise ValueError(f"chunk policy lacks {', '.join(missing)}")
    return {k: found[k] for k in CHUNKING}


def known_path(path: str, extra: set[str], derived: set[str], rules: set[str], fields: set[str]) -> bool:
    """Whether extraction or an earlier stage gives a path."""
    head, _, rest = path.partition(".")
    keys = {"header": HEADER_KEYS, "shipment": SHIPMENT_KEYS, "line": (*LINE_KEYS, "line_no")}
    if head in keys:
        return rest in keys[head] or head != "shipment" and rest.startswith("extra.") and rest[6:] in extra
    return head == "meta" and bool(rest) or path in derived or head in rules or head == "field" and rest in fields


def _expression(text: str) -> tuple[list[str], list[str], str]:
    """The paths of an expression, warnings, and why it can't be compiled."""
    try:
        tree = parse(text)
        check(tree)
        return list(paths(tree)), list(lint(tree)), ""
    except ExprError as e:
        return [], [], str(e)


def _fields(book: Mapping, names: dict[str, set[str]]) -> Iterator[Finding]:
    fields, specs = book.get("fields") or {}, book.get("field_specs") or {}
    for name in specs:
        if name not in fields:
            yield 1, "error", f"field {name}", "not declared"
    for name, spec in fields.items():
        place, kind = f"field {name}", spec.get("from")
        if specs and name not in specs:
            yield 1, "error", place, "no such send field"
        if kind not in SOURCES:
            yield 2, "error", place, f"unknown source {kind}"
        if spec.get("format") and spec["format"] not in FORMATS:
            yield 2, "error", place, f"unknown format {spec['format']}"
        if kind == "rule" and spec.get("rule") not in names["rules"]:
            yield 3, "error", place, f"no rule {spec.get('rule')}"
        if kind == "table" and not any(name in (t.get("then") or []) for t in (book.get("tables") or {}).values()):
            yield 3, "error", place, "no table sets it"
        used = [spec[k] for k in ("path", "fallback") if spec.get(k)]
        if kind == "expr":
            found, warnings, problem = _expression(spec.get("expr", ""))
            used += found
            if problem:
                yield 4, "error", place, problem
            yield from ((4, "warn", place, w) for w in warnings)
        yield from ((5, "error", place, f"unknown path {p}") for p in used if not known_path(p, **names))
        if spec.get("todo"):
            yield 8, "report", place, str(spec["todo"])
        choices = spec.get("choices")
        if choices and (book.get("rules") or {}).get(choices, {}).get("kind") != "csv_choice":
            yield 14, "error", place, f"{choices} is no csv_choice rule"


def _tables(book: Mapping, names: dict[str, set[str]]) -> Iterator[Finding]:
    for name, table in (book.get("tables") or {}).items():
        place, columns, seen, open_ = f"table {name}", table.get("when") or [], set(), True
        for column in columns:
            if column.get("op") not in OPS:
                yield 2, "error", place, f"unknown comparison {column.get('op')}"
            yield from ((5, "error", place, f"unknown path {column[k]}") for k in ("source", "fallback_source") if column.get(k) and not known_path(column[k], **names))
        for i, row in enumerate(table.get("rows") or [], 1):
            when = tuple(map(str, row.get("when") or []))
            if len(when) != len(columns) or len(row.get("then") or []) != len(table.get("then") or []):
                yield 2, "error", f"{place}, row {i}", "not as wide as its table"
            if not open_:
                yield 6, "warn", f"{place}, row {i}", "never reached"
            elif when in seen:
                yield 6, "warn", f"{place}, row {i}", "same conditions as an earlier row"
            seen.add(when)
            open_ = open_ and any(w != "*" for w in when)
        if "on_no_match" not in table:
            yield 7, "warn", place, "on_no_match is not declared"


def _rules(book: Mapping, names: dict[str, set[str]]) -> Iterator[Finding]:
    for name, rule in (book.get("rules") or {}).items():
        place, kind = f"rule {name}", rule.get("kind")
        if kind not in KINDS:
            yield 2, "error", place, f"unknown kind {kind}"
        yield from ((5, "error", place, f"unknown path {rule[k]}") for k in ("source", "key", "fallback_source") if isinstance(rule.get(k), str) and not known_path(rule[k], **names))
        if kind != "fixed" and "on_no_match" not in rule:
            yield 7, "warn", place, "on_no_match is not declared"
        yield from ((8, "report", f"{place}, entry {i}", str(e["todo"])) for i, e in enumerate(rule.get("entries") or [], 1) if e.get("todo"))
        if kind == "csv_choice" and (rule.get("on_many") or {}).get("action") == "default":
            yield 13, "error", place, "several candidates can't have a default"


def book_report(book: Mapping) -> list[Finding]:
    """(check, level, place, message) of a rule book as it is written and merged: checks 1 to 9 and 12 to 14.

    1 send fields declared, 2 known words, 3 tables and rules that exist, 4 expressions, 5 paths, 6 rows that are repeated or never reached, 7 misses
    declared, 8 open points, 9 owner, 12 chunk policy, 13 no default for several candidates, 14 choices of a csv_choice rule.
    """
    extra = {str(f["name"]) for f in (book.get("extraction") or {}).get("extra_fields") or []}
    derived = {c for t in (book.get("tables") or {}).values() for c in t.get("then") or [] if str(c).startswith("_")}
    names = {"extra": extra, "derived": derived, "rules": set(book.get("rules") or {}), "fields": set(book.get("fields") or {})}
    out = [*_fields(book, names), *_tables(book, names), *_rules(book, names)]
    if not str((book.get("meta") or {}).get("owner") or "").strip():
        out.append((9, "warn", "meta.owner", "nobody owns this rule book"))
    for key, value in ((book.get("extraction") or {}).get("chunking") or {}).items():
        if key not in CHUNKING:
            out.append((12, "error", f"extraction.chunking.{key}", "unknown key"))
        elif key == "enabled" and not isinstance(value, bool) or key != "enabled" and (isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0):
            out.append((12, "error", f"extraction.chunking.{key}", f"not a value for it: {value}"))
    return out


def reference_report(books: DataFrame, brands: DataFrame, manual: DataFrame, outputs: DataFrame) -> DataFrame:
    """(check, level, place, message) of reference tables against rule books: checks 10, 11 and 15 to 19, each a join.

    books: book, customer_no, name. brands: kunnr, zbrand, name1, _ord. manual: kunnr, zbrand, action, note, _ord. outputs: book, customer_no, value, what
    rules of a book may put out.
    10 values that aren't registered for the customer (after manual corrections), 11 no row of the customer, 15 another name there, 16 several values to choose from,
    17 unknown action or no note, 18 a correction of what isn't there, 19 every correction.
    """
    row = lambda df, number, level, place, message: df.select(F.lit(number).alias("check"), F.lit(level).alias("level"), place.alias("place"), message.alias("message"))
    book, pair = F.concat(F.lit("book "), "book"), F.concat_ws("/", "kunnr", "zbrand")
    key = ["kunnr", "zbrand"]
    held = brands.select(*key).distinct()
    good = manual.filter(~blank(F.col("kunnr")) & ~blank(F.col("zbrand")))
    registered = registered_codes(brands, manual)
    mine = lambda df: df.withColumn("kunnr", F.col("customer_no"))
    unknown = mine(outputs).withColumn("zbrand", F.col("value")).filter(~blank(F.col("value"))).distinct().join(registered, key, "left_anti")
    named = brands.filter(~blank(F.col("name1"))).groupBy("kunnr").agg(F.min_by("name1", "_ord").alias("name1"))
    other = mine(books).join(named, "kunnr").filter("name1 <> name")
    several = registered.groupBy("kunnr").agg(F.count("*").alias("n")).filter("n > 1")
    bad = manual.filter(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | blank(F.trim("note")))
    astray = good.filter("action IN ('override', 'suppress')").join(held, key, "left_anti")
    parts: list[tuple[DataFrame, int, str, Column, Column]] = [
        (unknown, 10, "error", book, F.concat(F.lit("not registered: "), "value")),
        (mine(books).join(brands.select("kunnr").distinct(), "kunnr", "left_anti"), 11, "warn", book, F.concat(F.lit("no row of customer "), "customer_no")),
        (other, 15, "warn", book, F.concat("name", F.lit(" is "), "name1", F.lit(" there"))),
        (mine(books).join(several, "kunnr"), 16, "report", book, F.concat(F.col("n").cast("string"), F.lit(" to choose from"))),
        (bad, 17, "error", pair, F.lit("unknown action or no note")),
        (astray, 18, "error", pair, F.concat(F.lit("nothing to "), "action")),
        (manual, 19, "report", pair, F.coalesce("action", F.lit(""))),
    ]
    out = row(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(row(*p))
    return out


def book_views(spark: SparkSession, books: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """Rule books as seven tables, for people and for joins: customers, fixed, document, decision, expressions, hints, and guide (what each table is)."""
    text = lambda x: "" if x is None else str(x)
    views: dict[str, tuple[str, list[tuple]]] = {
        "customers": ("code, name, customer_no, file_types, owner, status, split_by, split_label", []), "fixed": ("code, field, value, todo, explain", []), "document": ("code, field, path, format, required, fallback", []),
        "decision": ("code, name, scope, sources, comparisons, conditions, fields, values, on_no_match", []), "expressions": ("code, field, expr, explain", []), "hints": ("code, hints", []), "guide": ("view, columns", []),
    }
    add = lambda view, *values: views[view][1].append(tuple(map(text, values)))
    joined = lambda values: " / ".join(map(text, values))
    for code, book in books.items():
        meta, split = book.get("meta") or {}, book.get("split") or {}
        add("customers", meta.get("code", code), meta.get("name"), meta.get("customer_no"), joined(meta.get("file_types") or []), meta.get("owner"), meta.get("status", "draft"), split.get("by", "none"), split.get("label"))
        for field, spec in (book.get("fields") or {}).items():
            if spec.get("from") == "const":
                add("fixed", code, field, spec.get("value"), spec.get("todo"), spec.get("explain"))
            elif spec.get("from") == "doc":
                add("document", code, field, spec.get("path"), spec.get("format"), "Y" if spec.get("required") else "N", spec.get("fallback"))
            elif spec.get("from") == "expr":
                add("expressions", code, field, spec.get("expr"), spec.get("explain"))
        for name, table in (book.get("tables") or {}).items():
            columns, miss = table.get("when") or [], table.get("on_no_match") or {}
            for row in table.get("rows") or []:
                add("decision", code, name, table.get("scope", "header"), joined(c.get("source") for c in columns), joined(c.get("op") for c in columns), joined(row.get("when") or []), joined(table.get("then") or []), joined(row.get("then") or []), f"{miss.get('action', '')}: {miss.get('message', '')}".strip(": "))
        if (book.get("extraction") or {}).get("hints"):
            add("hints", code, book["extraction"]["hints"])
    for view, (columns, _) in views.items():
        add("guide", view, columns)
    return {view: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split(", "))) for view, (columns, rows) in views.items()}
