"""Calendar expressions on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(day: Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(day) + 1


def calendar_columns(day: Column) -> dict[str, Column]:
    """The six calendar features of the training matrix."""
    return {
        "dayofweek": iso_weekday(day),
        "dayofmonth": F.dayofmonth(day),
        "dayofyear": F.dayofyear(day),
        "weekofyear": F.weekofyear(day),
        "month": F.month(day),
        "year": F.year(day),
    }


def days_ago(day: Column, n: int | Column) -> Column:
    return F.date_sub(day, n)


def days_ahead(day: Column, n: int | Column) -> Column:
    return F.date_add(day, n)


def year_ahead(day: Column) -> Column:
    """Same day next year; Feb 29 becomes Feb 28."""
    return F.add_months(day, 12)


def is_leap_day(day: Column) -> Column:
    return (F.month(day) == 2) & (F.dayofmonth(day) == 29)


def parse_day(text: Column, order: str = "ymd") -> Column:
    """Parse ``2016-08-15`` (``ymd``) or the day-before-month form ``2016-15-08`` (``ydm``)."""
    patterns = {"ymd": "yyyy-MM-dd", "ydm": "yyyy-dd-MM"}
    return F.to_date(text, patterns[order])


def day_label(base: str, offset: Column) -> Column:
    """Text date ``base + offset`` days, used to label timetable periods."""
    return F.date_format(F.date_add(F.lit(base).cast("date"), offset.cast("int")), "yyyy-MM-dd")
