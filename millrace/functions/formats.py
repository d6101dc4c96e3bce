"""Field formats as (value, failed) pairs of Columns. Empty text passes through; a failed format keeps the text as it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import format_number
from .text import strip, strip_column

Pair = tuple[Column, Column]


def _plain(f: Callable[[Column], Column]) -> Callable[[Column], Pair]:
    return lambda c: (f(c), F.lit(False))


def integer_of(n: Column) -> Pair:
    return F.floor(n).cast("decimal(38,0)").cast("string"), n.isNull() | (n % 1 != 0)


def decimal3_of(n: Column) -> Pair:
    return F.bround(n, 3).cast("decimal(38,3)").cast("string"), n.isNull()


def integer(c: Column) -> Pair:
    """'25.000' and '1,250' become '25' and '1250'; a fraction fails."""
    return integer_of(format_number(c))


def decimal3(c: Column) -> Pair:
    """Three decimals, half to even."""
    return decimal3_of(format_number(c))


def date_parts(raw: Column) -> Column:
    """The three parts of a stripped text that looks like a date, in the order of the text; null for any other text."""
    known = raw.rlike(r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{8}|\d{1,2}[-./]\d{1,2}[-./](?:\d{2}|\d{4}))$")
    packed = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    parts = F.split(F.when(F.length(raw) == 8, F.when(raw.rlike(r"^\d{8}$"), packed).otherwise(raw)).otherwise(raw), "[-./]")
    return F.when(known, parts)


def date_numbers(p: Column) -> Column:
    """The parts as numbers, and whether the year comes first."""
    first, second, last = (F.get(p, F.lit(i)).try_cast("int") for i in range(3))
    return F.struct((F.length(F.get(p, F.lit(0))) == 4).alias("ymd"), first.alias("first"), second.alias("second"), last.alias("last"))


def date_fields(x: Column) -> Column:
    """Year, month and day of such numbers."""
    ymd, first, second, last = (x[k] for k in ("ymd", "first", "second", "last"))
    year = F.when(ymd, first).when(last < 100, last + 2000).otherwise(last)
    month = F.when(ymd, second).when(first <= 12, first).otherwise(second)
    day = F.when(ymd, last).when(first <= 12, second).otherwise(first)
    return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))


def date_text(x: Column) -> Column:
    text = F.concat(*(F.lpad(x[k].cast("string"), n, "0") for k, n in (("year", 4), ("month", 2), ("day", 2))))
    return F.when(x["month"].between(1, 12) & x["day"].between(1, 31), text)


def date_yyyymmdd(c: Column) -> Pair:
    """Y-M-D, Y.M.D, Y/M/D or YYYYMMDD; else M/D/Y, or D/M/Y if the first number is over 12. Only ranges are checked."""
    whole = lambda p: date_text(date_fields(date_numbers(p)))
    text = F.get(F.transform(F.array(date_parts(strip(c))), whole), F.lit(0))  # the parts are computed once
    return text, text.isNull()


def strip_parens(c: Column) -> Column:
    """Without bracket groups (half or full width, not nested) and the white space before them."""
    return strip(F.regexp_replace(c, r"(?U)\s*[(（][^()（）]*[)）]", ""))


FORMATS: dict[str, Callable[[Column], Pair]] = {
    "integer": integer,
    "decimal3": decimal3,
    "date_yyyymmdd": date_yyyymmdd,
    "upper": _plain(F.upper),
    "lower": _plain(F.lower),
    "trim": _plain(strip),
    "strip_parens": _plain(strip_parens),
}


#: Formats in steps, for plans that can give each step a column: what a step makes is used several times by the next one, and computed once.
STEPS: dict[str, tuple[tuple[Callable[[Column], Column], ...], Callable[[Column], Pair]]] = {
    "integer": ((format_number,), integer_of),
    "decimal3": ((format_number,), decimal3_of),
    "date_yyyymmdd": ((strip_column, date_parts, date_numbers, date_fields, date_text), lambda text: (text, text.isNull())),
}


def checked(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return name


def settled(c: Column, value: Column, failed: Column) -> Pair:
    failed = F.when(c == "", F.lit(False)).otherwise(F.coalesce(failed, F.lit(True)))
    return F.when((c == "") | failed, c).otherwise(value), failed


def apply_format(name: str, c: Column) -> Pair:
    """The formatted text, or the text itself where it is empty or the format fails, and whether it failed."""
    return settled(c, *FORMATS[checked(name)](c))


def add_formats(rows: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Adds `_f_{column}`, a struct of text and failed as apply_format() gives them, for each column of formats (column: format)."""
    at = {n: F.col(n) for n, name in formats.items() if checked(name)}
    for depth in range(max((len(STEPS[name][0]) for name in formats.values() if name in STEPS), default=0)):
        deep = [n for n, name in formats.items() if name in STEPS and len(STEPS[name][0]) > depth]
        rows = rows.withColumns({f"_s{depth}_{n}": STEPS[formats[n]][0][depth](at[n]) for n in deep})
        at |= {n: F.col(f"_s{depth}_{n}") for n in deep}
    pairs = {n: settled(F.col(n), *(STEPS[name][1] if name in STEPS else FORMATS[name])(at[n])) for n, name in formats.items()}
    return rows.withColumns({f"_f_{n}": F.struct(text.alias("text"), failed.alias("failed")) for n, (text, failed) in pairs.items()})
