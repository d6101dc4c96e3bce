"""Text primitives: white space, case, comparisons, normalizers and regular expressions, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space with the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: The characters that SPACE matches.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(SPACES))


def strip_column(c: Column) -> Column:
    """strip() of a column, or of a field of one: texts that begin and end with a visible ASCII character, as most do, aren't searched for spaces."""
    visible = lambda x: F.ascii(x).between(33, 126)
    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(strip(c))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def casefold(c: Column) -> Column:
    """Lower case, with sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank(c: Column) -> Column:
    """True for null and ''."""
    return F.coalesce(c, F.lit("")) == ""


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Padded at the left, and never cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, fill[:1] or " ")).otherwise(c)


NORMALIZERS: dict[str, Callable[[Column], Column]] = {"trim": strip, "collapse_spaces": lambda c: strip(collapse_spaces(c)), "upper": F.upper, "lower": F.lower}


def normalize(c: Column, steps: list[str]) -> Column:
    """Applies normalizers in order; an unknown one is an error when the rule book is compiled."""
    for step in steps:
        if step not in NORMALIZERS:
            raise ValueError(f"unknown normalizer: {step}")
        c = NORMALIZERS[step](c)
    return c


def java_regex(pattern: str) -> str:
    """A Python-style pattern in Java's dialect, with Unicode classes; what has no twin there is refused."""
    re.compile(pattern)
    if re.search(r"\(\?\(|\(\?[aLux]", pattern):
        raise ValueError(f"pattern not supported: {pattern}")
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return "(?U)" + out.replace(r"\Z", r"\z")


def group_number(pattern: str, group: int | str) -> int:
    compiled = re.compile(pattern)
    if isinstance(group, str) and not group.isdigit():
        return compiled.groupindex[group]
    if int(group) > compiled.groups:
        raise ValueError(f"no group {group} in {pattern}")
    return int(group)


#: op(source, needle). An empty needle of contains_ci matches all.
OPS: dict[str, Callable[[Column, str], Column]] = {
    "contains_ci": lambda s, n: F.contains(casefold(s), casefold(F.lit(n))),
    "equals": lambda s, n: s == F.lit(n),
    "equals_ci": lambda s, n: casefold(s) == casefold(F.lit(n)),
    "starts_with": lambda s, n: F.startswith(s, F.lit(n)),
    "regex": lambda s, n: s.rlike(java_regex(n)),
}
