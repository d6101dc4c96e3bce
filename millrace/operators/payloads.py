"""Payloads as extraction returns them, read as VARIANT: a value is a scalar or a struct with its anchor, and a line's anchor holds for its
values. They become rows for the engine, or (path, value) rows for grounding. Nothing here shuffles.

Numbers are read as what they are worth: 5.0 is the text 5. A payload with one key twice in one object can't be read.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip, strip_column
from .engine import HEADER_KEYS, LINE_KEYS, SHIPMENT_KEYS, VALUE

ANCHORS = ("src", "src_end", "page", "confidence")
#: Lines and shipments as one pass over a payload reads them. Each cast to VARIANT builds its part anew, so that only single values are. What is no object is null.
LINES = "array<map<string,variant>>"
SHIPMENTS = "array<struct<" + ",".join(f"{k}:variant" for k in ("src", "src_end", *SHIPMENT_KEYS)) + f",lines:{LINES}>>"
#: A value with an anchor of its own.
WRAPPED = "struct<value:variant," + ",".join(f"{k}:variant" for k in ANCHORS) + ">"
# What is judged more strictly, and what must occur somewhere in the document.
REQUIRED_LEAVES, REQUIRED_PATHS, PART_LEAVES = ("quantity", "item_code", "our_item"), ("header.po_number",), ("item_code", "our_item")


def part(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def mark(v: Column) -> Column:
    """What a small variant is, by two letters of its type: OB an object, AR an array, ST a text, BO a boolean, VO null, others are numbers."""
    return F.substring(F.schema_of_variant(v), 1, 2)


def scalar_text(v: Column, text: Column) -> Column:
    """A value, of which the text is known, as text without white space at its ends; booleans as True and False, lists and structs as JSON."""
    return strip_column(F.when(text.isin("true", "false") & (mark(v) == "BO"), F.initcap(text)).otherwise(text))


def whole(v: Column, m: Column) -> Column:
    """412, "412" and 412.0 are 412; booleans and other texts are no numbers."""
    text = strip(F.try_variant_get(v, "$", "string"))
    digits = F.when(text.rlike(r"\A[-+]?[0-9]+(_[0-9]+)*\z"), F.replace(text, F.lit("_"), F.lit("")).try_cast("int"))
    return F.when(m == "ST", digits).when(m != "BO", F.try_variant_get(v, "$", "int"))


def real(v: Column, m: Column) -> Column:
    text = strip(F.try_variant_get(v, "$", "string"))
    number = F.when(text.rlike(r"\A[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"), text.try_cast("double"))
    return F.when(m == "ST", number).when(m != "BO", F.try_variant_get(v, "$", "double"))


def struct(fields: Mapping[str, Column]) -> Column:
    """A struct by names; names given as aliases are lost where a struct of VARIANT parts stands in another expression."""
    return F.named_struct(*(x for k, c in fields.items() for x in (F.lit(k), c)))


READ = {"src": whole, "src_end": whole, "page": whole, "confidence": real}


def anchors(fields: Column) -> dict[str, Column]:
    """The anchor of a line, of which the values by name are given, as columns."""
    return {k: READ[k](fields[k], mark(fields[k])) for k in ANCHORS}


def inherited(wrapped: Column, given: Mapping[str, Column] | None) -> dict[str, Column]:
    """The anchor of a value: what its own leaves out is taken from its line's."""
    none = lambda k: F.lit(None).cast("double" if k == "confidence" else "int")
    at = lambda k: F.coalesce(mark(wrapped[k]), F.lit("VO"))
    return {k: F.when(wrapped.isNotNull() & (at(k) != "VO"), READ[k](wrapped[k], mark(wrapped[k]))).otherwise(given[k] if given else none(k)) for k in ANCHORS}


def leaves(values: Column, anchor: Mapping[str, Column] | None = None, anchored: bool = True) -> Column:
    """An array of variants of either form as an array of structs; what a value's own anchor leaves out is taken from `anchor`. Without
    `anchored` all anchors are null. A missing value is null, and nothing is worked out for it. The steps name what later ones use more than once, so that the expression stays small."""
    there = lambda x, fields: F.when(x.isNotNull(), struct(fields))
    known = F.transform(values, lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), struct({"v": v, "own": F.try_variant_get(v, "$", WRAPPED)})))
    known = F.transform(known, lambda x: there(x, {"own": x["own"], "inner": F.when(x["own"].isNotNull(), x["own"]["value"]).otherwise(x["v"])}))
    known = F.transform(known, lambda x: there(x, {"own": x["own"], "inner": x["inner"], "text": F.try_variant_get(x["inner"], "$", "string")}))
    bare = {k: F.lit(None).cast("double" if k == "confidence" else "int") for k in ANCHORS}
    return F.transform(known, lambda x: there(x, {"value": scalar_text(x["inner"], x["text"]), **(inherited(x["own"], anchor) if anchored else bare)}))


def leaf(v: Column) -> Column:
    return F.get(leaves(F.array(v)), F.lit(0))


def payload_problem(v: Column) -> Column:
    """Why a payload can't be read, or null. Missing and null parts are empty ones. Whether a part is of its kind is asked by casts that build nothing of it."""
    kinds = {"an object": "struct<_:boolean>", "a list": "array<boolean>"}
    bad = F.when(F.try_variant_get(v, "$", kinds["an object"]).isNull(), "the payload is no JSON object")
    for key, said in (("header", "an object"), ("totals", "an object"), ("lines", "a list"), ("shipments", "a list")):
        there = part(v, key).isNotNull() & ~F.is_variant_null(part(v, key))
        bad = bad.when(part(v, key, kinds[said]).isNull() & there, f"{key} is not {said}")
    return bad


def listed(v: Column, key: str, kind: str = LINES) -> Column:
    return F.coalesce(part(v, key, kind), F.array().cast(kind))


def lines_of(shipment: Column, kind: str = LINES) -> Column:
    return F.coalesce(shipment["lines"], F.array().cast(kind))


def _typed(rows: DataFrame, node: str, keys: Sequence[str], extra_fields: Sequence[str] | None, anchor: Mapping[str, Column] | None = None, wanted: Collection[str] | None = None, anchored: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """Adds the values of a node's keys and extra fields, of which `node` is a map, and tells the fields of its struct. wanted, anchored: see payload_rows."""
    needed = lambda k: wanted is None or k in wanted
    found, more = f"{node}_values", f"{node}_extra"
    own = [k for k in keys if needed(k)]
    rows = rows.withColumn(more, F.try_variant_get(F.col(node)["extra"], "$", "map<string,variant>") if needed("extra") else F.lit(None).cast("map<string,variant>"))
    given = F.col(more)
    declared = [*own, *(extra_fields or ())]
    none = F.lit(None).cast(VALUE)
    if declared:
        rows = rows.withColumn(found, leaves(F.array(*(F.col(node)[k] for k in own), *(given[name] for name in extra_fields or ())), anchor, anchored))
    at = {k: F.get(found, F.lit(i)) for i, k in enumerate(own)}
    if extra_fields:
        extra = struct({name: F.get(found, F.lit(len(own) + i)) for i, name in enumerate(extra_fields)})
    elif extra_fields is None and needed("extra"):
        extra = F.map_from_arrays(F.map_keys(given), leaves(F.map_values(given), anchor, anchored))
    else:
        extra = F.lit(None).cast(f"map<string,{VALUE}>")
    return rows, {**{k: at.get(k, none) for k in keys}, "extra": extra}


def chunk_range(pair: Column) -> tuple[Column, Column]:
    """The lines that a line's chunk may point at, if the merge left two whole numbers there. pair: what chunk_pair gives."""
    lo, hi = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    two = (F.size(pair) == 2) & lo.isNotNull() & hi.isNotNull()
    return F.when(two, lo), F.when(two, hi)


def chunk_pair(chunk: Column) -> Column:
    return F.transform(F.try_variant_get(chunk, "$", "array<variant>"), lambda x: whole(x, mark(x)))


def read_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Replaces the payload by `_v` (a VARIANT, null where it can't be read) and `problem` (why, or null). What follows doesn't filter by these,
    and explodes with explode_outer: a filter, and the one that is inferred of an explode, would be pushed below the parsing, and parse again for each use."""
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*rest, F.try_parse_json(column).alias("_v"))
    rows = rows.withColumn("problem", payload_problem(F.col("_v")))
    return rows.withColumn("_v", F.when(F.col("problem").isNull(), F.col("_v")))


def payload_rows(read: DataFrame, extra_fields: Sequence[str] | None = None, wanted: Collection[str] | None = None, anchored: bool = True) -> DataFrame:
    """One row for each line of what read_payloads gives, as the engine's build_rows takes them: header, totals, split, ship_idx, shipment,
    line, line_no (its place, whatever the payload says), and further columns.

    Payloads with a problem give none. If there are shipments, the lines above them are ignored. An item that is no object is a line without values.
    extra_fields: the names that a rule book declares (`extra` becomes a struct of those); None: `extra` is a map of what is there.
    wanted: the keys that are used (`extra` too); the values of others are null, and nothing is worked out for them. None: all.
    anchored: whether the anchors of values are read too; else they are null.
    """
    rest = [c for c in read.columns if c not in ("_v", "problem")]
    v, t = F.col("_v"), F.col("_t")
    place = lambda x: whole(x, mark(x))
    docs = read.select(*rest, part(v, "header", "map<string,variant>").alias("_h"), part(v, "totals", "struct<line_count:variant,total_qty:string,total_amount:string>").alias("_t"), listed(v, "shipments", SHIPMENTS).alias("_ships"), part(v, "lines", LINES).alias("_own"))
    docs, header = _typed(docs, "_h", HEADER_KEYS, extra_fields, wanted=wanted, anchored=anchored)
    totals = struct({"line_count": place(t["line_count"]), **{k: t[k] for k in ("total_qty", "total_amount")}})
    shipment_kind = SHIPMENTS.removeprefix("array<").removesuffix(">")
    unit = lambda i, s, lines: struct({"i": i, "s": s, "lines": lines})
    ships = F.col("_ships")
    units = F.when(F.size(ships) > 0, F.transform(ships, lambda s, i: unit(i + 1, s, lines_of(s)))).otherwise(F.array(unit(F.lit(0), F.lit(None).cast(shipment_kind), F.coalesce("_own", F.array().cast(LINES)))))
    own = ["header", "totals", "split"]
    docs = docs.select(*rest, struct(header).alias("header"), totals.alias("totals"), (F.size(ships) > 0).alias("split"), F.explode_outer(units).alias("_u"))
    used = [k for k in SHIPMENT_KEYS if wanted is None or k in wanted]
    s = F.col("_u.s")
    docs = docs.withColumn("_s_values", leaves(F.array(*(s[k] for k in used)), anchored=anchored) if used else F.array().cast(f"array<{VALUE}>"))
    none = F.lit(None).cast(VALUE)
    shipment = {"src": place(s["src"]), "src_end": place(s["src_end"]), **{k: F.get("_s_values", F.lit(used.index(k))) if k in used else none for k in SHIPMENT_KEYS}}
    docs = docs.select(*rest, *own, F.col("_u.i").alias("ship_idx"), F.when(F.col("_u.i") > 0, struct(shipment)).alias("shipment"), F.col("_u.lines").alias("_lines"))
    lines = docs.select(*rest, *own, "ship_idx", "shipment", F.posexplode("_lines").alias("_pos", "_l"))
    fields = F.col("_l")
    lines = lines.withColumns({**{f"_a_{k}": c for k, c in anchors(fields).items()}, "_chunk": chunk_pair(fields["chunk"])})
    anchor = {k: F.col(f"_a_{k}") for k in ANCHORS}
    lines, line = _typed(lines, "_l", LINE_KEYS, extra_fields, anchor, wanted, anchored)
    lo, hi = chunk_range(F.col("_chunk"))
    line = {"line_no": F.col("_pos") + 1, "src": anchor["src"], "src_end": anchor["src_end"], "lo": lo, "hi": hi, **line}
    return lines.select(*rest, *own, "ship_idx", "shipment", struct(line).alias("line"), (F.col("_pos") + 1).alias("line_no"))


def payload_values(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every value of a tree as a row: key, path, leaf, ship_idx, line_no (0: none), value, src, src_end, page, confidence, lo, hi.

    Paths are header.x, lines[i].x, shipments[i].x and shipments[i].lines[j].x, with .extra. before names of `extra`, all counted from 1. Lines above
    shipments are told too. Missing values are left out, blank ones not.

    Nodes are rows before their values are looked at, and values are rows before they are read, so that what is done to each is compiled code.
    """
    v, zero = F.col("_v"), F.lit(0)
    node = lambda kind, i, j, fields: struct({"kind": F.lit(kind), "ship_idx": i.cast("int"), "line_no": j.cast("int"), "fields": fields})
    parts = read.select(key, part(v, "header", "map<string,variant>").alias("_header"), listed(v, "lines").alias("_lines"), listed(v, "shipments", SHIPMENTS).alias("_ships"))
    ship = lambda s, i: F.concat(
        F.array(node("shipment", i + 1, zero, F.create_map(*(x for k in SHIPMENT_KEYS for x in (F.lit(k), s[k]))))),
        F.transform(lines_of(s), lambda x, j: node("line", i + 1, j + 1, x)),
    )
    nodes = F.concat(F.array(node("header", zero, zero, F.col("_header"))), F.transform("_lines", lambda x, i: node("line", zero, i + 1, x)), F.flatten(F.transform("_ships", ship)))
    rows = parts.select(key, F.explode_outer(nodes).alias("_n")).select(key, "_n.*")
    fields, own, head = F.col("fields"), F.col("kind") == "line", F.col("kind") == "header"
    rows = rows.withColumns({**{f"_a_{k}": F.when(own, c) for k, c in anchors(fields).items()}, "_chunk": F.when(own, chunk_pair(fields["chunk"])), "_more": F.when(own | head, F.try_variant_get(fields["extra"], "$", "map<string,variant>"))})
    lo, hi = chunk_range(F.col("_chunk"))
    place = F.when(F.col("ship_idx") > 0, F.concat(F.lit("shipments["), F.col("ship_idx").cast("string"), F.lit("]."))).otherwise("")
    path = F.when(head, "header.").when(own, F.concat(place, F.lit("lines["), F.col("line_no").cast("string"), F.lit("]."))).otherwise(place)
    # What a node has, and not every key that it may have.
    named = lambda name, e: struct({"name": name, "v": e["value"]})
    known = lambda e: F.when(own, e["key"].isin(*LINE_KEYS)).when(head, e["key"].isin(*HEADER_KEYS)).otherwise(e["key"].isin(*SHIPMENT_KEYS))
    none = F.array().cast("array<struct<name:string,v:variant>>")
    mine = F.coalesce(F.transform(F.filter(F.map_entries(fields), known), lambda e: named(e["key"], e)), none)
    more = F.when(F.col("_more").isNotNull(), F.transform(F.map_entries("_more"), lambda e: named(F.concat(F.lit("extra."), e["key"]), e))).otherwise(none)
    rows = rows.select(key, path.alias("_path"), "ship_idx", "line_no", *(f"_a_{k}" for k in ANCHORS), lo.alias("lo"), hi.alias("hi"), F.explode_outer(F.concat(mine, more)).alias("_x"))
    x = F.col("_x.v")
    rows = rows.withColumn("_own", F.try_variant_get(x, "$", WRAPPED))
    rows = rows.withColumn("_inner", F.when(F.col("_own").isNotNull(), F.col("_own.value")).otherwise(x))
    rows = rows.withColumn("_text", F.try_variant_get("_inner", "$", "string"))
    rows = rows.withColumn("_value", scalar_text(F.col("_inner"), F.col("_text")))
    anchor = inherited(F.col("_own"), {k: F.col(f"_a_{k}") for k in ANCHORS})
    path = F.concat("_path", "_x.name")
    out = {"path": path, "leaf": F.substring_index(path, ".", -1), "ship_idx": F.col("ship_idx"), "line_no": F.col("line_no"), "value": F.col("_value"), **anchor, "lo": F.col("lo"), "hi": F.col("hi")}
    # Not a filter alone: it would go below these steps, and read every value a second time.
    return rows.select(key, F.explode_outer(F.when(F.col("_value").isNotNull(), F.array(struct(out)))).alias("_y")).filter("_y IS NOT NULL").select(key, "_y.*")


def to_ground(values: DataFrame) -> DataFrame:
    """values with the booleans required and part, as `ground` takes them."""
    return values.withColumn("required", F.col("leaf").isin(*REQUIRED_LEAVES) | F.col("path").isin(*REQUIRED_PATHS)).withColumn("part", F.col("leaf").isin(*PART_LEAVES))


def structure_issues(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path, level, code): NO_LINES of documents and shipments, and TOTAL_MISMATCH of the printed line count and quantity.

    A quantity that can't be read, or no printed total, turns the second off. Anything but digits, dots and minus signs is ignored in numbers.
    """
    v, line_kind = F.col("_v"), "array<struct<quantity:variant>>"
    number = lambda text: F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(38,10)")
    parts = read.select(
        key, F.col("problem").isNull().alias("_good"), listed(v, "shipments", f"array<struct<lines:{line_kind}>>").alias("_s"), listed(v, "lines", line_kind).alias("_own"),
        part(v, "totals", "struct<line_count:variant,total_qty:string>").alias("_t"),
    )
    ships, t = F.col("_s"), F.col("_t")
    lines = F.when(F.size(ships) > 0, F.flatten(F.transform(ships, lambda s: lines_of(s, line_kind)))).otherwise(F.col("_own"))
    rows = parts.select(key, "_good", "_s", lines.alias("_l"), number(t["total_qty"]).alias("_printed"), whole(t["line_count"], mark(t["line_count"])).alias("_count"))
    rows = rows.withColumn("_q", F.transform(leaves(F.transform("_l", lambda line: line["quantity"])), lambda q: number(q["value"])))
    added = F.aggregate("_q", F.lit(0).cast("decimal(38,10)"), lambda a, q: F.try_add(a, q).cast("decimal(38,10)"))
    error = lambda path, code: struct({"path": path, "level": F.lit("error"), "code": F.lit(code)})
    told = lambda test, path, code: F.when(F.coalesce(test, F.lit(False)), error(F.lit(path), code))
    bare = F.transform("_s", lambda s, i: F.when(F.size(lines_of(s, line_kind)) == 0, error(F.format_string("shipments[%d].lines", i + 1), "NO_LINES")))
    found = F.concat(
        F.array(told(F.col("_count") != F.size("_l"), "totals.line_count", "TOTAL_MISMATCH"), told(F.col("_printed") != added, "totals.total_qty", "TOTAL_MISMATCH"), told(F.size("_l") == 0, "lines", "NO_LINES")),
        bare,
    )
    return rows.select(key, F.explode_outer(F.when(F.col("_good"), F.filter(found, lambda x: x.isNotNull()))).alias("_i")).filter("_i IS NOT NULL").select(key, "_i.*")


def ground_payloads(read: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, path, level, code) of all that grounding finds in payloads: anchors and confidence of every value, lines that are missing, and totals.

    documents: doc_id, lines, has_text, anchored. Scans, and documents that were read without line numbers, have their anchors not judged; a
    payload without a document has its structure judged alone.
    """
    from .grounding import ground

    return ground(to_ground(payload_values(read)).filter(~blank(F.col("value"))), documents).unionByName(structure_issues(read))
