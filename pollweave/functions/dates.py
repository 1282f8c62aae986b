"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_day(text: Column, pattern: str = "dd.MM.yyyy") -> Column:
    """Text to date; text in another form becomes NULL."""
    return F.try_to_date(text, pattern)


def mean_date(day: Column) -> Column:
    """Average of dates (aggregate), cut to whole days."""
    return F.date_from_unix_date(F.floor(F.avg(F.unix_date(day))).cast("int"))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
