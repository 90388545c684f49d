"""Windows over daily series: at most one row per series and day.

Every frame orders by the DATE column itself, so all features of a table share one shuffle and one
sort. The calendar bounds the rows of a series, whatever share of the raw facts it received.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SERIES = ("product_id", "store_id")


def _bound(days: int) -> str:
    if days == 0:
        return "CURRENT ROW"
    return f"{abs(days)} {'PRECEDING' if days < 0 else 'FOLLOWING'}"


def over_days(
    aggregate: str, first: int, last: int, keys: Sequence[str] = SERIES, day: str = "c_date"
) -> Column:
    """SQL ``aggregate`` over the rows dated ``day + first`` … ``day + last`` of the same series."""
    return F.expr(
        f"{aggregate} OVER (PARTITION BY {', '.join(keys)} ORDER BY {day}"
        f" RANGE BETWEEN {_bound(first)} AND {_bound(last)})"
    )


def value_in_days(
    column: str, offset: int, keys: Sequence[str] = SERIES, day: str = "c_date"
) -> Column:
    """``column`` of the row exactly ``offset`` days later (negative: earlier), else NULL.

    The zero-width frame does the work of a shifted self-join without another shuffle.
    """
    return over_days(f"max({column})", offset, offset, keys, day)


def rows_of_series(keys: Sequence[str] = SERIES, day: str = "c_date"):
    return Window.partitionBy(*keys).orderBy(day)
