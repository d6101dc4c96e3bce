"""The five number parsers. Each stage of the engine reads numbers in its own way; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

KIND = "decimal(38,18)"


def format_number(c: Column) -> Column:
    """Formats: commas and white space go; what isn't a number then is null."""
    return F.regexp_replace(c, r"(?U)[,\s]", "").try_cast(KIND)


def validator_number(c: Column) -> Column:
    """Row validation: commas go."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast(KIND)


def grounding_number(c: Column) -> Column:
    """Printed totals in a document: everything goes but digits, dots and minus signs."""
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast(KIND)


def totals_number(c: Column) -> Column:
    """Totals: commas and outer white space go."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).try_cast(KIND)


def summary_number(c: Column) -> Column:
    """Summary: whole part of a plain number, 0 for anything else ('1,250' too)."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0))
