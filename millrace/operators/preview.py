"""What a rule book says about its fields before any document is read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from . import engine
from . import rules as R

FIXED = "field string, label string, title string, value string, note string"


def label_of(book: Mapping, name: str) -> str:
    return str(book["field_specs"].get(name, {}).get("label") or name)


def title_of(book: Mapping, name: str) -> str:
    """The one name by which a field is shown: its label and its code."""
    return f"{label_of(book, name)} - {book['field_specs'].get(name, {}).get('code') or name}"


def field_list(book: Mapping) -> list[dict]:
    """The fields in order, with what is said of each."""
    known = lambda spec: {k: spec[k] for k in ("code", "sheet", "type", "max_len") if spec.get(k) not in (None, "")}
    return [{"name": name, "label": label_of(book, name), **known(spec)} for name, spec in book["field_specs"].items()]


def todos(book: Mapping) -> Iterator[tuple[str, str]]:
    """(field or rule, note) of what isn't settled yet."""
    for name, spec in book["fields"].items():
        if spec.get("todo"):
            yield name, str(spec["todo"])
    for name, rule in book["rules"].items():
        for entry in rule.get("map") or []:
            if entry.get("todo"):
                yield name, f"{entry.get('value', '')}: {entry['todo']}"


def fixed_values(spark: SparkSession, book: Mapping) -> DataFrame:
    """(field, label, title, value, note) of fields that no document can change: constants, base values, expressions over meta alone, and
    choices that their rule shows as fixed (also if the customer has none). Fields that are only sent are left out.

    An expression is judged by the paths that it reads, not by its value: one over an empty document has a value too.
    """
    one = spark.range(1)
    scope = engine.Scope(book.get("meta", {}), one)
    found: list[tuple[str, Column, bool]] = []
    for name, spec in book["fields"].items():
        rule = book["rules"].get(spec.get("rule"), {}) if spec["from"] == "rule" else {}
        if book["field_specs"].get(name, {}).get("send_only"):
            continue
        if spec["from"] in ("const", "base"):
            plain = spec.get("value") if spec["from"] == "const" else book.get("base", {}).get(name)
            found.append((name, F.lit("" if plain is None else str(plain)), False))
        elif spec["from"] == "expr" and all(p.startswith("meta.") for p in X.paths(X.parse(spec["expr"]))):
            compiled = X.compile_expr(spec["expr"], scope)
            found.append((name, F.when(compiled.error.isNull(), X.as_text(compiled)), False))
        elif rule.get("kind") == "csv_choice" and rule.get("preview") == "fixed":
            one = R.csv_choice(one, book["references"][rule["ref"]], F.lit(str(book["meta"].get("customer_no", ""))), rule["filter_column"], rule["value_column"], f"_c_{name}")
            found.append((name, F.col(f"_c_{name}"), True))
    if not found:
        return spark.createDataFrame([], FIXED)
    note = lambda n: F.lit(book["fields"][n].get("explain")).cast("string")
    rows = [F.struct(F.lit(n).alias("field"), F.lit(label_of(book, n)).alias("label"), F.lit(title_of(book, n)).alias("title"), F.coalesce(v, F.lit("")).alias("value"), note(n).alias("note"), F.lit(always).alias("always")) for n, v, always in found]
    return one.select(F.explode(F.array(*rows)).alias("f")).select("f.*").filter("always OR value <> ''").drop("always")
