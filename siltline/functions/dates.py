"""Dates as text, as the pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_date(date: Column) -> Column:
    return F.date_format(date.cast("date"), "d MMMM yyyy")


def short_date(date: Column) -> Column:
    return F.date_format(date.cast("date"), "d MMM yyyy")


def clock_utc(stamp: Column) -> Column:
    """HH:MM of a stamp like 2026-08-22T10:00:00Z."""
    return F.substring(stamp, 12, 5)


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))
