"""The expression language of rule books, compiled to Columns.

An expression is a literal, a list, a dotted path or a call; there are no operators. It is parsed once, on the driver, and becomes a
pair of Columns: the value, and an error code that is null where there is none. `if` is lazy: errors of the branch not taken don't count.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import apply_format
from .text import strip


class ExprError(ValueError):
    """An expression that can't be compiled."""


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Items:
    items: tuple


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


# The language's functions, and its escapes below. name: (least arguments, most, result, argument kinds; the last repeats)
FUNCTIONS: dict[str, tuple[int, int | None, str, tuple[str, ...]]] = {
    "concat": (1, None, "text", ("any",)),
    "join": (2, 2, "text", ("text", "list")),
    "compact": (1, 1, "list", ("list",)),
    "coalesce": (1, None, "any", ("any",)),
    "if": (3, 3, "any", ("any", "any", "any")),
    "contains": (2, 2, "bool", ("text", "text")),
    "in": (2, 2, "bool", ("any", "list")),
    "upper": (1, 1, "text", ("text",)),
    "lower": (1, 1, "text", ("text",)),
    "trim": (1, 1, "text", ("text",)),
    "replace": (3, 3, "text", ("text", "text", "text")),
    "substr": (3, 3, "text", ("text", "num", "num")),
    "pad": (3, 3, "text", ("text", "num", "text")),
    "integer": (1, 1, "text", ("any",)),
    "decimal3": (1, 1, "text", ("any",)),
    "date_yyyymmdd": (1, 1, "text", ("any",)),
}
_TOKEN = re.compile(r"""[ \t]*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[ \t]*\.[ \t]*[A-Za-z_][A-Za-z0-9_]*)*)|(?P<mark>[\[\](),]))""")
_ESCAPES = {"\\": "\\", '"': '"', "'": "'"}


def _tokens(source: str) -> list[tuple[str, str]]:
    if "\n" in source or "\r" in source:
        raise ExprError("an expression is one line")
    out, at = [], 0
    while source[at:].strip(" \t"):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExprError(f"can't read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _text(token: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise ExprError(f"unknown escape \\{m[1]}")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, token[1:-1])


def parse(source: str):
    """The tree of an expression."""
    tokens, at = _tokens(source), 0

    def take(mark: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise ExprError(f"{source!r} ends too early")
        token = tokens[at]
        if mark and token[1] != mark:
            raise ExprError(f"{mark} expected before {token[1]!r}")
        at += 1
        return token

    def several(end: str) -> tuple:
        items = []
        while at < len(tokens) and tokens[at][1] != end:
            items.append(value())
            if at == len(tokens) or tokens[at][1] != ",":
                break
            take(",")
            if at < len(tokens) and tokens[at][1] == end:
                raise ExprError(f"a value expected before {end}")
        take(end)
        return tuple(items)

    def value():
        kind, token = take()
        if kind == "text":
            return Literal(_text(token))
        if kind == "num":
            return Literal(float(token) if "." in token else int(token))
        if token == "[":
            return Items(several("]"))
        if kind != "name":
            raise ExprError(f"{token!r} can't stand here")
        if token in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[token])
        if at < len(tokens) and tokens[at][1] == "(":
            take("(")
            return Call(token, several(")"))
        steps = [step.strip(" \t") for step in token.split(".")]
        if steps[0] in ("true", "false", "null"):
            raise ExprError(f"{steps[0]} is no path")
        return Path(".".join(steps))

    tree = value()
    if at < len(tokens):
        raise ExprError(f"{tokens[at][1]!r} is left over in {source!r}")
    return tree


def kind_of(node) -> str:
    if isinstance(node, Literal):
        return {bool: "bool", int: "num", float: "num", str: "text"}.get(type(node.value), "any")
    if isinstance(node, Items):
        return "list"
    return FUNCTIONS[node.name][2] if isinstance(node, Call) else "any"


def check(node) -> None:
    """Known functions, number and kinds of arguments."""
    if isinstance(node, Items):
        for x in node.items:
            check(x)
    if not isinstance(node, Call):
        return
    if node.name not in FUNCTIONS:
        raise ExprError(f"unknown function: {node.name}")
    least, most, _, kinds = FUNCTIONS[node.name]
    if len(node.args) < least or most is not None and len(node.args) > most:
        raise ExprError(f"{node.name} takes {least}" + ("" if most == least else " or more") + f" arguments, not {len(node.args)}")
    for i, arg in enumerate(node.args):
        check(arg)
        want, got = kinds[min(i, len(kinds) - 1)], kind_of(arg)
        if want != "any" and got not in ("any", want):
            raise ExprError(f"argument {i + 1} of {node.name} is {got}, not {want}")


def paths(node) -> list[str]:
    """Paths that an expression reads, in order."""
    if isinstance(node, Path):
        return [node.name]
    inner = node.items if isinstance(node, Items) else node.args if isinstance(node, Call) else ()
    return list(dict.fromkeys(p for x in inner for p in paths(x)))


def lint(node) -> list[str]:
    """Warnings: contains() with a literal text before a path looks swapped."""
    inner = node.items if isinstance(node, Items) else node.args if isinstance(node, Call) else ()
    own = ["contains(text, needle): the arguments look swapped"] if isinstance(node, Call) and node.name == "contains" and isinstance(node.args[0], Literal) and isinstance(node.args[1], Path) else []
    return own + [w for x in inner for w in lint(x)]


@dataclass
class Value:
    """A compiled node: kind is text, num, bool, list or any (text that may be null); error is null where all is well."""

    column: Column
    error: Column
    kind: str



def truthy(v: Value) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "list":
        return F.size(v.column) > 0
    if v.kind == "num":
        return F.coalesce(v.column != 0, F.lit(False))
    return F.coalesce(v.column != "", F.lit(False))


def as_text(v: Value) -> Column:
    """Null and false are '', true is 'true'; a list has no text."""
    if v.kind == "list":
        raise ExprError("a list can't be the final text")
    if v.kind == "bool":
        return F.when(v.column, F.lit("true")).otherwise(F.lit(""))
    return F.coalesce(v.column.cast("string"), F.lit(""))


def compile_expr(source, resolve: Callable[[str], Column | None]) -> Value:
    """Compiles an expression (text or tree). resolve: a path's text column, or None if there is no such path."""
    tree = parse(source) if isinstance(source, str) else source
    check(tree)
    return _compile(tree, resolve)


def _first_error(*values: Value) -> Column:
    return F.coalesce(*(v.error for v in values), F.lit(None).cast("string"))


def _compile(node, resolve) -> Value:
    fine = F.lit(None).cast("string")
    if isinstance(node, Literal):
        if node.value is None:
            return Value(F.lit(None).cast("string"), fine, "any")
        return Value(F.lit(node.value), fine, kind_of(node))
    if isinstance(node, Path):
        column = resolve(node.name)
        return Value(F.lit(None).cast("string") if column is None else column, fine, "any")
    if isinstance(node, Items):
        items = [_compile(x, resolve) for x in node.items]
        array = F.array(*[F.when(_is_null(v), F.lit(None).cast("string")).otherwise(as_text(v)) for v in items]) if items else F.array().cast("array<string>")
        return Value(array, _first_error(*items), "list")
    args = [_compile(x, resolve) for x in node.args]
    name = node.name
    if name == "if":
        test, yes, no = args
        kind = yes.kind if yes.kind == no.kind else "any"
        a, b = (yes.column, no.column) if kind == yes.kind == no.kind else (as_text(yes), as_text(no))
        taken = F.when(truthy(test), yes.error).otherwise(no.error)
        return Value(F.when(truthy(test), a).otherwise(b), F.coalesce(test.error, taken), kind)
    error = _first_error(*args)
    text = [as_text(v) if v.kind != "list" else None for v in args]
    if name == "concat":
        if any(t is None for t in text):
            raise ExprError("concat takes texts, not lists")
        return Value(F.concat(*text), error, "text")
    if name == "join":
        return Value(F.array_join(F.transform(args[1].column, lambda x: F.coalesce(x, F.lit(""))), _literal(node.args[0])), error, "text")
    if name == "compact":
        return Value(F.filter(args[0].column, lambda x: x.isNotNull() & (x != "")), error, "list")
    if name == "coalesce":
        return Value(F.coalesce(*[F.when(truthy(v), as_text(v)) for v in args]), error, "any")
    if name == "contains":
        return Value(F.contains(text[0], text[1]), error, "bool")
    if name == "in":
        return Value(F.array_contains(F.transform(args[1].column, lambda x: F.coalesce(x, F.lit(""))), text[0]), error, "bool")
    if name in ("upper", "lower", "trim"):
        return Value({"upper": F.upper, "lower": F.lower, "trim": strip}[name](text[0]), error, "text")
    if name == "replace":
        return Value(_replace(text[0], text[1], text[2]), error, "text")
    if name == "substr":
        return Value(_slice(text[0], int(float(_literal(node.args[1]))), int(float(_literal(node.args[2])))), error, "text")
    if name == "pad":
        width, fill = int(float(_literal(node.args[1]))), str(_literal(node.args[2]))[:1] or " "
        return Value(F.when(F.length(text[0]) < width, F.lpad(text[0], width, fill)).otherwise(text[0]), error, "text")
    value, failed = apply_format(name, text[0])
    return Value(value, F.coalesce(error, F.when(failed, F.lit(f"{name}: bad value"))), "text")


def _is_null(v: Value) -> Column:
    return v.column.isNull()


def _literal(node):
    if not isinstance(node, Literal):
        raise ExprError("a literal is needed here")
    return "" if node.value is None else node.value


def _replace(s: Column, old: Column, new: Column) -> Column:
    """All occurrences; an empty `old` puts `new` around every character."""
    around = F.concat(new, F.regexp_replace(s, r"(?s)(.)", F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1"))))
    return F.when(old == "", around).otherwise(F.replace(s, old, new))


def _slice(s: Column, start: int, length: int) -> Column:
    """s[start:start + length], as Python slices."""
    end, n = start + length, F.length(s)
    at = F.greatest(F.lit(0), n + start) if start < 0 else F.lit(start)
    to = F.greatest(F.lit(0), n + end) if end < 0 else F.lit(end)
    return F.substring(s, at + 1, F.greatest(F.lit(0), to - at))
