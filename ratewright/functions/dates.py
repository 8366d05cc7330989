"""Dates as they are written in charge files, and how fresh they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_date(text: Column) -> Column:
    """ISO (four, two, two digits) or month/day/year; null for any other form and for days that don't exist."""
    iso, us = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
    return F.when(text.rlike(iso), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(us), F.try_to_date(text, "M/d/yyyy"))


def anniversary(day: Column) -> Column:
    """A calendar year later; 29 February becomes the 28th."""
    return F.add_months(day, 12)


def freshness(day: Column, as_of: Column) -> Column:
    """Overdue begins the day after the anniversary."""
    return F.when(day.isNull(), "unusable").when(day > as_of, "future").when(as_of > anniversary(day), "overdue").otherwise("ok")


def utc_date(text: Column) -> Column:
    """The day in UTC of an ISO time with a zone (``Z`` or an offset); null for any other text."""
    zoned = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})\z")
    at = F.try_to_timestamp(F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2"))
    return F.when(zoned, F.to_date(F.to_utc_timestamp(at, F.current_timezone())))
