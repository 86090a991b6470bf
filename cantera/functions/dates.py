"""Strict dates, ages and staleness; the present day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(text: Column) -> Column:
    """A date of the form yyyy-mm-dd that the calendar has; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def age_in_days(date: Column, today: Column) -> Column:
    return F.datediff(today, date)


def is_stale(age: Column, limit: int = 90) -> Column:
    """An unknown age is stale."""
    return age.isNull() | (age > limit)
