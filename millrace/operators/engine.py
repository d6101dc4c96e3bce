"""The row engine: nested extractions become flat order rows under a rule book.

Stages: SPLIT (explode shipments or lines), CONTEXT (paths), TABLES, RULES, FIELDS, VALIDATE. All are Columns of one plan; one shuffle
by document serves row numbers, whole-document checks and likely-missed warnings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import expr as X
from ..functions.formats import add_formats, apply_format
from ..functions.numbers import format_number, validator_number
from ..functions.text import blank, normalize, or_blank, pad_left, strip_column
from . import rules as R

# The vocabulary of extractions.
HEADER_KEYS = ("po_number", "po_date", "requested_date", "brand_text", "order_text", "ship_to_text", "bill_to_text", "currency_text", "incoterms_text", "payment_terms_text", "packing_spec", "remark_default")
SHIPMENT_KEYS = ("shipment_no", "receiving_loc", "ship_to_text", "ship_by_text", "remark")
LINE_KEYS = ("posex", "our_item", "item_code", "description", "quantity", "unit", "unit_price", "net_value", "delivery_date", "ship_to_text", "brand_text", "remark")
#: Without a configured path, the first of these that isn't blank labels a group.
GROUP_KEYS = ("receiving_loc", "shipment_no")
VALUE = "struct<value:string,src:int,src_end:int,page:int,confidence:double>"
LINE = "struct<line_no:int,src:int,src_end:int," + ",".join(f"{k}:{VALUE}" for k in LINE_KEYS) + f",extra:map<string,{VALUE}>>"
SHIPMENT = "struct<src:int,src_end:int," + ",".join(f"{k}:{VALUE}" for k in SHIPMENT_KEYS) + f",lines:array<{LINE}>>"
HEADER = "struct<" + ",".join(f"{k}:{VALUE}" for k in HEADER_KEYS) + f",extra:map<string,{VALUE}>>"
#: The typed tree of one document's extraction, as parsed from JSON.
PAYLOAD = f"struct<header:{HEADER},lines:array<{LINE}>,shipments:array<{SHIPMENT}>,totals:struct<line_count:int,total_qty:string,total_amount:string>>"
#: Bytes of a method's code that the JVM compiles at most. The fused code of a rule book's fields is larger.
JIT_BYTES = 8000
ISSUE = "struct<field:string,severity:string,code:string,message:string>"


def parse_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Adds `po`, the typed tree of a JSON payload; a payload that can't be read gives null, never an exception."""
    return payloads.withColumn("po", F.from_json(column, PAYLOAD))


def split_orders(documents: DataFrame) -> DataFrame:
    """One row for each item: doc_id, ship_idx (0 without shipments), line_no (restarting in each order unit), header, shipment, line, split.

    If there are shipments, the lines above them are ignored.
    """
    has = F.size(F.coalesce("po.shipments", F.array().cast(f"array<{SHIPMENT}>"))) > 0
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast(SHIPMENT).alias("shipment"), F.col("po.lines").alias("lines")))
    units = F.when(has, F.transform("po.shipments", lambda s, i: F.struct((i + 1).alias("i"), s.alias("shipment"), s["lines"].alias("lines")))).otherwise(alone)
    rest = [c for c in documents.columns if c != "po"]
    rows = documents.select(*rest, F.col("po.header").alias("header"), F.col("po.totals").alias("totals"), has.alias("split"), F.explode(units).alias("u"))
    return rows.select(*rest, "header", "totals", "split", F.col("u.i").alias("ship_idx"), F.col("u.shipment").alias("shipment"), F.posexplode("u.lines").alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).drop("_pos")


class Scope:
    """Names to Columns: meta.x, header.x, shipment.x, line.x (and .extra.x), _derived, field.X, rule names and rule.key."""

    def __init__(self, meta: Mapping[str, str], rows: DataFrame):
        self.meta, self.named, self.once = dict(meta), {}, {}
        self.keys = {h: set(rows.schema[h].dataType.fieldNames()) for h in ("header", "shipment", "line") if h in rows.columns}
        kinds = {h: rows.schema[h].dataType["extra"].dataType for h in ("header", "line") if "extra" in self.keys.get(h, ())}
        self.extra = {h: set(kind.fieldNames()) for h, kind in kinds.items() if isinstance(kind, StructType)}

    def computed_once(self, rows: DataFrame) -> DataFrame:
        """rows with a column for each value of header, shipment and line, which paths are resolved to from now on. Those without use
        are pruned; those used once stand in their place again."""
        plain = lambda h: [f.name for f in rows.schema[h].dataType if isinstance(f.dataType, StructType) and "value" in f.dataType.fieldNames()]
        paths = [f"{h}.{k}" for h in self.keys for k in plain(h) if k not in ("src", "src_end", "lines", "extra")]
        names = {p: f"_c{i}" for i, p in enumerate(paths)}
        rows = rows.withColumns({name: self(p) for p, name in names.items()})
        self.once = {p: F.col(name) for p, name in names.items()}
        return rows

    def __call__(self, path: str) -> Column | None:
        if path in self.once:
            return self.once[path]
        head, _, rest = path.partition(".")
        if head == "meta":
            return F.lit(str(self.meta[rest])) if rest in self.meta else None
        if head in ("header", "shipment", "line"):
            if rest.startswith("extra.") and head != "shipment":
                if "extra" not in self.keys.get(head, ()) or rest[6:] not in self.extra.get(head, (rest[6:],)):
                    return None
                return or_blank(F.col(f"{head}.extra")[rest[6:]]["value"])
            if head == "line" and rest == "line_no":
                return F.col("line_no").cast("string")
            return or_blank(strip_column(F.col(f"{head}.{rest}.value"))) if rest in self.keys.get(head, ()) - {"src", "src_end", "lines", "extra"} else None
        if path in self.named:
            return self.named[path]
        if head in self.named and rest:
            return self.named[head][rest]
        return None


def issue(field: str, severity: str | Column, code: str, message: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(field).alias("field"), level.alias("severity"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def message(template: str, scope: Scope) -> Column:
    """A message with {leaf} placeholders: the first of meta, header, shipment, line that has the name, then derived values."""
    import re

    parts: list[Column] = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            found = [c for c in (scope(f"{space}.{name}") for space in ("meta", "header", "shipment", "line")) if c is not None]
            found += [c for c in (scope(f"_{name}"),) if c is not None]
            parts.append(found[0] if found else F.lit("{" + name + "}"))
    return F.concat(*parts) if parts else F.lit("")


def severity(miss: Mapping | None, test: Column) -> Column:
    """Where test holds, the severity that on_no_match or on_many asks for: error, warn (also if it says nothing), or null."""
    action = (miss or {}).get("action", "warn")
    return F.when(test, action) if action in ("error", "warn") else F.lit(None).cast("string")


def _kept(issues: list[Column]) -> Column:
    """The issues that are there, in order; a concatenation and no filter by a lambda, which would be interpreted for each row."""
    none = F.array().cast(f"array<{ISSUE}>")
    return F.concat(none, *(F.when(x["code"].isNotNull(), F.array(x)).otherwise(none) for x in issues))


def _when(test: Column, what: Column) -> Column:
    return F.when(test, what).otherwise(F.lit(None).cast(ISSUE))


def render(rows: DataFrame, values: Mapping[str, Column], specs: Mapping[str, Mapping], scope: Scope) -> tuple[DataFrame, dict[str, Column]]:
    """Adds fields, and tells the issue of each whose format failed: value, then fallback if blank, then format, then default if blank. A
    failed format keeps the text, and skips the default. All fields go through a step together, as later steps use it more than once."""
    other = lambda path: or_blank(scope(path)) if scope(path) is not None else F.lit("")
    have = lambda key: [n for n in values if specs[n].get(key) is not None]
    rows = rows.withColumns(dict(values))
    rows = rows.withColumns({n: F.when(blank(F.col(n)), other(specs[n]["fallback"])).otherwise(F.col(n)) for n in have("fallback") if specs[n]["fallback"]})
    formats = [n for n in have("format") if specs[n]["format"]]
    rows = add_formats(rows, {n: specs[n]["format"] for n in formats})
    rows = rows.withColumns({n: F.col(f"_f_{n}.text") for n in formats})
    free = lambda n: blank(F.col(n)) & ~F.col(f"_f_{n}.failed") if n in formats else blank(F.col(n))
    rows = rows.withColumns({n: F.when(free(n), F.lit(str(specs[n]["default"]))).otherwise(F.col(n)) for n in have("default")})
    failed = lambda n: issue(n, "error", "FORMAT_ERROR", F.concat(F.lit(f"{specs[n]['format']}: "), F.col(n)))
    return rows, {n: _when(F.col(f"_f_{n}.failed"), failed(n)) for n in formats}


def build(documents: DataFrame, book: Mapping) -> DataFrame:
    """Order rows of documents with doc_id and `po`, a typed tree: split, then build_rows."""
    return build_rows(split_orders(documents), book)


def compiled_stages(rows: DataFrame) -> DataFrame:
    """rows, in a session that gives up fusing a stage whose code has a method beyond JIT_BYTES: fused, it would be interpreted for each row."""
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > JIT_BYTES:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_BYTES))
    return rows


def build_rows(rows: DataFrame, book: Mapping, keep_columns: Sequence[str] = ()) -> DataFrame:
    """Order rows: doc_id, row_id, group, line_no, keep_columns of rows, one string column for each send field, issues.

    rows: doc_id, ship_idx, line_no, split, totals, and the structs header, shipment and line, each with the keys that are needed. book: meta, base, tables, rules, fields, field_specs (in order), split, validation. Missing values are
    '', never null. Field names and order come from field_specs. Issues stand in the order tables, rules, fields, row validation, checks,
    likely missed.
    """
    scope = Scope(book.get("meta", {}), rows)
    # Numbered while rows are narrow: the sort carries no rendered fields.
    order = Window.partitionBy("doc_id").orderBy("ship_idx", "line_no")
    rows = compiled_stages(rows).withColumn("row_id", F.format_string("r_%04d", F.row_number().over(order)))
    rows = scope.computed_once(rows)
    found: list[str] = []

    def keep(issues: list[Column]) -> None:
        nonlocal rows
        names = [f"_i{len(found) + i}" for i in range(len(issues))]
        found.extend(names)
        rows = rows.withColumns(dict(zip(names, issues, strict=True)))

    assigned: dict[str, Column] = {}
    for n, table in enumerate(book.get("tables", [])):
        values, missed = R.decision_table(table, scope)
        rows = rows.withColumn(f"_t{n}", values)
        names = R.table_names(table)
        for k in names:
            (scope.named if k.startswith("_") else assigned)[k] = F.col(f"_t{n}")[k]
        miss = table.get("on_no_match", {"action": "warn"})
        target = next((k for k in names if not k.startswith("_")), "")
        keep([_when(missed, issue(target, "error" if miss.get("action") == "error" else "warn", "TABLE_NO_MATCH", message(miss.get("message", table.get("name", "")), scope)))])

    used = {s.get("rule") for s in book["fields"].values() if s.get("from") == "rule"} | {p.split(".")[0] for s in book["fields"].values() if s.get("from") == "expr" for p in X.paths(X.parse(s["expr"]))}
    references = book.get("references", {})
    for name, rule in book.get("rules", {}).items():
        level, said = F.lit(None).cast("string"), message((rule.get("on_no_match") or {}).get("message", name), scope)
        if rule["kind"] in R.COLUMN_RULES:
            value, level = R.on_miss(R.COLUMN_RULES[rule["kind"]](rule, scope), rule)
            rows = rows.withColumn(f"_r_{name}", value)
        elif rule["kind"] == "lookup":
            key = or_blank(scope(rule["key"])) if "key" in rule and scope(rule["key"]) is not None else R.source_of(rule, scope) if "source" in rule else F.lit("")
            rows = R.lookup(rows, references[rule["ref"]], key, rule["key_column"], rule["return"], f"_r_{name}")
            level = severity(rule.get("on_no_match"), F.col(f"_r_{name}_missed"))
        elif rule["kind"] == "csv_choice":
            rows = R.csv_choice(rows, references[rule["ref"]], F.lit(str(scope.meta.get("customer_no", ""))), rule["filter_column"], rule["value_column"], f"_r_{name}")
            count = F.col(f"_r_{name}_count")
            none, many = rule.get("on_no_match") or {}, rule.get("on_many") or {}
            if none.get("action") == "default":
                rows = rows.withColumn(f"_r_{name}", F.when(count == 0, F.lit(str(none.get("value", "")))).otherwise(F.col(f"_r_{name}")))
            level = F.coalesce(severity(none, count == 0), severity(many, count > 1))
            several = F.replace(F.lit(many.get("message", name)), F.lit("{count}"), count.cast("string"))
            said = F.when(count == 0, message(none.get("message", name), scope)).otherwise(several)
        elif rule["kind"] == "csv_map":
            fold, longest = rule.get("case", "sensitive") == "insensitive", rule.get("longest_first", False)
            if "entries" in rule:
                rows = R.csv_map(rows, rule["entries"], R.source_of(rule, scope), f"_r_{name}", longest, rule.get("mode") == "equals", fold)
            else:
                source = normalize(R.source_of(rule, scope), rule.get("normalize", []))
                rows = R.csv_map_table(rows, references[rule["ref"]], source, f"_r_{name}", rule["key_column"], rule["value_column"], rule.get("filter_column"), str(scope.meta.get("customer_no", "")), rule.get("mode_column"), longest, fold)
            value, level = R.on_miss(F.col(f"_r_{name}"), rule)
            rows = rows.withColumn(f"_r_{name}", value)
        else:
            level, said = F.lit("error"), F.lit(f"{name}: unknown kind {rule['kind']}")
            rows = rows.withColumn(f"_r_{name}", F.lit(""))
        scope.named[name] = F.col(f"_r_{name}")
        if name in used:
            keep([_when(level.isNotNull(), issue(rule.get("field", ""), level, "RULE_NO_MATCH", said))])

    specs: Mapping[str, Mapping] = book["field_specs"]
    derived, values, early = [], {}, {}
    for name in specs:
        spec = book["fields"].get(name)
        if spec is None:
            values[name], early[name] = F.lit(""), issue(name, "error", "FIELD_NOT_DECLARED", name)
            continue
        kind = spec["from"]
        if kind == "const":
            value = F.lit(str(spec["value"]))
        elif kind == "base":
            value = F.lit(str(book.get("base", {}).get(name, "")))
        elif kind == "doc":
            column = scope(spec["path"])
            value = F.lit("") if column is None else or_blank(column)
        elif kind == "table":
            value = or_blank(assigned[name]) if name in assigned else F.lit("")
        elif kind == "rule":
            plain = book.get("rules", {}).get(spec["rule"], {}).get("kind") != "lookup"
            value = or_blank(scope.named[spec["rule"]]) if plain else F.lit("")
        elif kind == "gen":
            value = pad_left((F.col("line_no") * 10).cast("string"), 6)
        else:
            if any(p.startswith("field.") for p in X.paths(X.parse(spec["expr"]))):
                derived.append(name)
            compiled = X.compile_expr(spec["expr"], lambda p: F.lit("") if p.startswith("field.") else scope(p))
            value = F.when(compiled.error.isNull(), X.as_text(compiled)).otherwise(F.lit(""))
            early[name] = _when(compiled.error.isNotNull(), issue(name, "error", "EXPR_ERROR", compiled.error))
        values[name] = value
    rows, late = render(rows, values, {n: book["fields"].get(n, {}) for n in specs}, scope)
    keep([issues[n] for n in specs for issues in (early, late) if n in issues])
    rows = recompute_derived(rows, book, derived, scope)
    keep(row_validation(specs))
    rows = rows.withColumn("issues", _kept([*map(F.col, found)]))

    rows = rows.withColumn("group", group_label(scope, book.get("split", {}).get("group_label")))
    for check, options in book.get("validation", {}).items():
        if check in CHECKS:
            rows = CHECKS[check](rows, options)
    own = [n for n in book.get("own_fields", []) if book["fields"].get(n, {}).get("from") not in (None, "const")]
    rows = likely_missed(rows, own)
    return rows.select("doc_id", "row_id", "group", "line_no", *keep_columns, *specs, "issues")


def group_label(scope: Scope, path: str | None = None) -> Column:
    """The configured path, else the receiving location, else the shipment number, else ''."""
    names = [p for p in (path, *(f"shipment.{k}" for k in GROUP_KEYS)) if p]
    return F.coalesce(*[F.nullif(scope(p), F.lit("")) for p in names if scope(p) is not None], F.lit(""))


def recompute_derived(rows: DataFrame, book: Mapping, names: list[str], scope: Scope, manual: str | None = None) -> DataFrame:
    """Fields whose expression reads other fields, again on live values, in field order; other paths are empty then, and there is no default. A failing expression or format keeps the old
    value; fields in the array column `manual` stay as they are."""
    for name in names:
        spec = book["fields"][name]
        live = X.compile_expr(spec["expr"], lambda p: F.col(p[6:]) if p.startswith("field.") and p[6:] in rows.columns else None)
        value = X.as_text(live)
        failed = live.error.isNotNull()
        if spec.get("format"):
            text, bad = apply_format(spec["format"], value)
            value, failed = F.when(value == "", value).otherwise(text), failed | (bad & (value != ""))
        held = failed if manual is None else failed | F.array_contains(manual, name)
        rows = rows.withColumn(name, F.when(held, F.col(name)).otherwise(value))
    return rows


def row_validation(specs: Mapping[str, Mapping]) -> list[Column]:
    """Issues of one row, in field order: required, nonzero, max_len."""
    out = []
    for name, spec in specs.items():
        value = F.col(name)
        if spec.get("required"):
            missing = blank(value)
            for other in spec.get("required_unless", []):
                missing = missing & blank(F.col(other))
            out.append(_when(missing, issue(name, "error" if spec["required"] is True else "warn", "REQUIRED_MISSING", name)))
        if spec.get("nonzero"):
            out.append(_when(F.coalesce(validator_number(value) == 0, F.lit(False)), issue(name, "error" if spec["nonzero"] is True else "warn", "ZERO", name)))
        if spec.get("max_len"):
            out.append(_when(F.length(value) > spec["max_len"], issue(name, "error", "TOO_LONG", F.concat(F.lit(f"{name}: {spec['max_len']} < "), F.length(value).cast("string")))))
    return out


def shipment_total_match(rows: DataFrame, options: Mapping) -> DataFrame:
    """On every row of a split document, an issue if its quantities don't add up to the printed total. A quantity that can't be read, or
    no printed total, turns the check off."""
    field = options.get("field", "KWMENG")
    if field not in rows.columns:
        return rows
    whole = Window.partitionBy("doc_id")
    printed = format_number(F.col("totals.total_qty"))
    total = F.sum(format_number(F.col(field))).over(whole)
    unread = F.sum(format_number(F.col(field)).isNull().cast("int")).over(whole)
    wrong = F.col("split") & printed.isNotNull() & (unread == 0) & (total != printed)
    extra = F.when(F.coalesce(wrong, F.lit(False)), F.array(issue(field, options.get("severity", "error"), "TOTAL_MISMATCH", F.concat(F.col("totals.total_qty"), F.lit(" printed"))))).otherwise(F.array().cast(f"array<{ISSUE}>"))
    return rows.withColumn("issues", F.concat("issues", extra))


#: Known checks; others are skipped.
CHECKS = {"shipment_total_match": shipment_total_match}


def likely_missed(rows: DataFrame, names: list[str], doc: str = "doc_id") -> DataFrame:
    """A warning on blank cells of fields that most rows of the document fill, unless the cell has an issue already."""
    whole = Window.partitionBy(doc)
    for name in names:
        empty = F.sum(blank(F.col(name)).cast("int")).over(whole)
        most = F.count("*").over(whole) - empty > empty
        free = ~F.coalesce(F.array_contains(F.col("issues.field"), name), F.lit(False))
        test = blank(F.col(name)) & most & free
        rows = rows.withColumn("issues", F.concat("issues", F.when(test, F.array(issue(name, "warn", "LIKELY_MISSED", name))).otherwise(F.array().cast(f"array<{ISSUE}>"))))
    return rows
