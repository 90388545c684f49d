"""Long and wide forms, list explosion and the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def planning_calendar(spark: SparkSession, date_from: str, window: int = 7) -> DataFrame:
    """The ``window`` days after ``date_from`` with rank 1, 2, …."""
    first = F.date_add(F.lit(date_from).cast("date"), 1)
    return date_spine(spark.range(1), first, F.date_add(first, window - 1)).drop("id")


def date_spine(
    df: DataFrame, first: Column, last: Column, day: str = "c_date", rank: str = "c_rank"
) -> DataFrame:
    """Each row of ``df`` once per day of ``[first, last]``; the array position is the rank."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return df.select("*", F.posexplode(days).alias("_pos", day)).select(
        *df.columns, day, (F.col("_pos") + 1).cast("int").alias(rank)
    )


def with_calendar(df: DataFrame, date_from: str, window: int = 7) -> DataFrame:
    """Cross every row with the planning days: a bounded explode instead of a join."""
    first = F.date_add(F.lit(date_from).cast("date"), 1)
    return date_spine(df, first, F.date_add(first, window - 1))


def wide_to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], days: Column, day: str, value: str
) -> DataFrame:
    """Zip an array of dates with one value column per date and explode both together."""
    zipped = F.arrays_zip(days.alias(day), F.array(*columns).alias(value))
    return df.select(*keys, F.inline(zipped).alias(day, value))


def explode_list(df: DataFrame, name: str, values: Sequence | Column) -> DataFrame:
    """Each row once per element."""
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return df.withColumn(name, F.explode(array))
