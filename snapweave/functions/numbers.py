"""Tolerant numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the panel that stands for full coverage.
PANEL = 1_148_000

_FINITE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def tolerant_double(text: Column) -> Column:
    """The number a text spells, infinities included; NULL for anything else. Never NaN."""
    number = F.when(text.rlike(_FINITE) | text.rlike(_INFINITE), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def tolerant_long(text: Column) -> Column:
    """The whole number a text spells (3850.0 is one); NULL for fractions, infinities and anything else."""
    d = tolerant_double(text)
    return F.when((F.abs(d) < 9.2e18) & (F.floor(d) == d), d.cast("long"))


def strict_long(text: Column) -> Column:
    """NULL for the empty text; raises for what is no whole number."""
    return F.nullif(text, F.lit("")).cast("long")


def panel_coverage(hits: Column, panel: int = PANEL) -> Column:
    """Coverage estimated from a count of sites."""
    return hits / F.lit(panel)
