"""Scalar expressions of the demand and stock formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_units(units: Column) -> Column:
    return F.log1p(units)


def units_from_log(value: Column) -> Column:
    """Inverse of :func:`log_units`, rounded to whole units."""
    return F.round(F.expm1(value)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL when the denominator is zero."""
    return F.try_divide(num, den)


def excess_over(level: Column, limit: Column | int) -> Column:
    return F.greatest(F.lit(0), level - limit)


def shortfall_under(level: Column, limit: Column | int) -> Column:
    return F.greatest(F.lit(0), limit - level)


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def flag_from_text(text: Column) -> Column:
    """'True' is true, everything else and NULL is false."""
    return F.coalesce(text == F.lit("True"), F.lit(False))


def strip_first(text: Column, literal: str) -> Column:
    """Remove the first occurrence of ``literal``; the literal is not a pattern."""
    at = F.locate(literal, text)
    head = F.substring(text, F.lit(1), at - 1)
    tail = F.substring(text, at + len(literal), F.length(text))
    return F.when(at > 0, F.concat(head, tail)).otherwise(text)


def ewm_last(values: Column, alpha: float = 0.9) -> Column:
    """Adjusted exponentially weighted mean at the last element of an array (oldest first).

    Folding ``num = num * (1 - alpha) + x`` and ``den = den * (1 - alpha) + 1`` gives the newest
    element weight 1 and every older one a further factor ``1 - alpha``.
    """
    decay = 1.0 - alpha
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    folded = F.aggregate(
        values,
        zero,
        lambda acc, x: F.struct(
            (acc["num"] * decay + x).alias("num"), (acc["den"] * decay + 1.0).alias("den")
        ),
        lambda acc: F.try_divide(acc["num"], acc["den"]),
    )
    return folded
