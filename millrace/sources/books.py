"""Rule books as they are written, made into what the row engine compiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import load_book

# What a rule book may say where the engine has a word of its own.
CASE = {True: "insensitive", False: "sensitive"}
ENTRY_KINDS = ("keyword_map", "value_map")


def written_table(name: str, table: Mapping) -> dict:
    """A decision table whose `then` names its columns once, with a list of values in each row."""
    names = [str(c) for c in table.get("then") or []]
    pairs = lambda values: dict(zip(names, (str(v) for v in values or []), strict=False))
    miss = dict(table.get("on_no_match") or {})
    if miss.get("action") == "default":
        miss["values"] = pairs(miss.pop("value", []))
    rows = [{"when": [str(x) for x in row.get("when") or []], "set": dict.fromkeys(names, "") | pairs(row.get("then"))} for row in table.get("rows") or []]
    return {"name": name, "columns": list(table.get("when") or []), "names": names, "rows": rows, "on_no_match": miss}


def written_rule(rule: Mapping) -> dict:
    """A mapping rule: entries that lack the rule's key are left out, a reference table goes by its file."""
    out = {k: v for k, v in rule.items() if k not in ("entries", "table_file", "order", "case_insensitive")}
    out["case"] = CASE[bool(rule.get("case_insensitive"))]
    out["longest_first"] = rule.get("order") == "longest_first"
    if rule.get("kind") in ENTRY_KINDS:
        key = "contains" if rule["kind"] == "keyword_map" else "equals"
        out["map"] = [{key: str(e[key]), "value": str(e.get("value", ""))} | ({"todo": e["todo"]} if e.get("todo") else {}) for e in rule.get("entries") or [] if key in e]
    if rule.get("table_file"):
        out["ref"] = str(rule["table_file"])
    return out


def written_book(book: Mapping, reference: Callable[[str, bool], DataFrame]) -> dict:
    """What the engine takes of a rule book: load_book() gives `book`; reference(file, optional) reads a table that a rule names."""
    rules = {name: written_rule(rule) for name, rule in (book.get("rules") or {}).items()}
    quantity = next((name for name, spec in (book.get("field_specs") or {}).items() if spec.get("role") == "quantity"), None)
    files = {r["ref"]: bool(r.get("optional")) or r["kind"] != "lookup" for r in rules.values() if "ref" in r}
    return {
        "meta": dict(book.get("meta") or {}),
        "base": dict(book.get("sap_defaults") or {}),
        "tables": [written_table(name, t) for name, t in (book.get("tables") or {}).items()],
        "rules": rules,
        "references": {file: reference(file, optional) for file, optional in files.items()},
        "fields": dict(book.get("fields") or {}),
        "field_specs": {name: dict(spec) | {k: v for k, v in (book["fields"].get(name) or {}).items() if k in CHECKED} for name, spec in (book.get("field_specs") or {}).items()},
        "split": dict(book.get("split") or {}),
        "validation": {c["id"]: ({"field": quantity} if quantity else {}) | c for c in book.get("checks") or []},
        "own_fields": list(book.get("own_fields") or []),
    }


# What a field says about its value's checks; the engine has them with the field's specification.
CHECKED = ("required", "required_unless", "nonzero")


def generic_book(texts: Mapping[str, str], customer: str, brands: DataFrame, extends: list[str]) -> dict:
    """The rule book of a customer that has none of its own but has brands (kunnr, name1, _ord): the books in `extends`, under the first
    name that isn't blank. Whether a customer is in the brand table is one filtered row."""
    mine = brands.filter(F.coalesce(F.col("kunnr"), F.lit("")) == customer)
    named = F.when(F.coalesce(F.col("name1"), F.lit("")) != "", F.col("_ord"))
    row = mine.agg(F.count("*").alias("n"), F.min_by("name1", named).alias("name")).first()
    if not row["n"]:
        raise ValueError(f"no rule book and no brand of customer {customer}")
    meta = {"code": customer, "name": row["name"] or customer, "customer_no": customer, "status": "active", "file_types": [], "generic": True}
    return load_book({**texts, customer: yaml.safe_dump({"meta": meta, "extends": extends})}, customer)
