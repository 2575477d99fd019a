"""Casts used where raw values enter the typed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the day inside a raw ``dt``, bare or as ``dt=YYYY-MM-DD``.
DAY_PATTERN = r"(\d{4}-\d{2}-\d{2})"


def lenient_cast(col: Column, to: str, strict: bool = False) -> Column:
    """Null for values that do not fit, or an error at run time when ``strict`` (ANSI mode)."""
    return col.cast(to) if strict else col.try_cast(to)


def day_of_text(col: Column, strict: bool = False) -> Column:
    return lenient_cast(F.regexp_extract(col.cast("string"), DAY_PATTERN, 1), "date", strict)
