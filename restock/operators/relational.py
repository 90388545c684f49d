"""Projections, joins and aggregates shared by the reports and the planning inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restock.operators.running import salt

# --- columns -----------------------------------------------------------------------------------

_TYPE_FAMILIES = {
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double"),
    "string": ("string",),
    "boolean": ("boolean",),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"),
}


def columns_of_type(df: DataFrame, *families: str) -> list[str]:
    wanted = {t for family in families for t in _TYPE_FAMILIES[family]}
    return [f.name for f in df.schema if f.dataType.simpleString() in wanted]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def drop_types(df: DataFrame, *families: str) -> DataFrame:
    return df.drop(*columns_of_type(df, *families))


def prefix_all(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def pop_columns(df: DataFrame, names: Sequence[str], key: Sequence[str]):
    """(rest, popped): both keep ``key`` so they can be joined again."""
    return df.drop(*[n for n in names if n not in key]), df.select(*key, *names)


# --- joins -------------------------------------------------------------------------------------


def full_grid(small: DataFrame, large: DataFrame, shards: int | None = None) -> DataFrame:
    """Every row of ``small`` with every row of ``large``.

    The pairs are the result here. ``large`` is spread over ``shards`` by hash and ``small`` is
    copied to each shard, so the grid is an equi-join that any number of tasks can share. There are
    as many shards as shuffle partitions unless given.
    """
    shards = shards or int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = small.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = large.withColumn("_shard", salt(large.columns, shards).cast("int"))
    return copies.join(spread, "_shard").drop("_shard")


def strict_map(
    df: DataFrame, column: str, mapping: DataFrame, name_col: str, id_col: str, check: bool = True
) -> DataFrame:
    """Replace names by ids; a name without an id fails the job (``check``) instead of giving NULL."""
    names = mapping.select(F.col(name_col).alias(column), F.col(id_col).alias("_id"))
    joined = df.join(names, column, "left")
    value: Column = F.col("_id")
    if check:
        unknown = F.concat(F.lit(f"{column}: no id for "), F.coalesce(F.col(column), F.lit("NULL")))
        value = F.when(F.col("_id").isNull(), F.raise_error(unknown)).otherwise(F.col("_id"))
    return joined.withColumn(column, value).drop("_id").select(*df.columns)


def unmatched_names(df: DataFrame, column: str, mapping: DataFrame, name_col: str) -> DataFrame:
    """Names of ``df`` that the mapping does not know."""
    known = mapping.select(F.col(name_col).alias(column))
    return df.select(column).distinct().join(known, column, "left_anti")


def map_literals(column: Column, mapping: Mapping) -> Column:
    """Strict mapping by a literal dictionary; an unknown value fails the job."""
    pairs = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
    found = F.element_at(pairs, column)
    unknown = F.concat(F.lit("no mapping for "), column.cast("string"))
    return F.when(found.isNull(), F.raise_error(unknown)).otherwise(found)


def active_days(
    windows: DataFrame, start: str, end: str, first_day: Column, last_day: Column, day: str
) -> DataFrame:
    """One row per day of ``[start, end)`` inside ``[first_day, last_day]``.

    The inequality join with a calendar becomes a clipped date sequence: no join at all.
    """
    # greatest and least skip NULLs; without a day range there is no active day
    known = first_day.isNotNull() & last_day.isNotNull()
    lo = F.when(known, F.greatest(F.col(start), first_day))
    hi = F.when(known, F.least(F.date_sub(F.col(end), 1), last_day))
    return (
        windows.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn(day, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))))
        .drop("_lo", "_hi")
    )


def interval_join(
    facts: DataFrame, windows: DataFrame, keys: Sequence[str], day: str, start: str, end: str
) -> DataFrame:
    """Left join each fact to the windows of its key with ``start <= day < end``.

    Windows become one row per day inside the facts' date range, so the join is an equi-join on key
    and day; nothing compares every fact of a key with every window of it.
    """
    first, last = facts.agg(F.min(day)).scalar(), facts.agg(F.max(day)).scalar()
    by_day = active_days(windows, start, end, first, last, day)
    return facts.join(by_day, [*keys, day], "left")


# --- aggregates --------------------------------------------------------------------------------


def sum_by_level(
    df: DataFrame, level: Sequence[str], measures: Sequence[str], day: str = "c_date"
) -> DataFrame:
    """Sum the measures that exist per ``level`` and day; an empty level gives day totals."""
    present = [m for m in measures if m in df.columns]
    return df.groupBy(*level, day).agg(*[F.sum(m).alias(m) for m in present])


def sum_all_levels(
    df: DataFrame, product: str, store: str, measures: Sequence[str], day: str = "c_date"
) -> DataFrame:
    """All four levels (total, product, store, both) per day in one pass; ``level`` names them."""
    present = [m for m in measures if m in df.columns]
    sets = [[day], [product, day], [store, day], [product, store, day]]
    level = (
        F.when((F.grouping(product) == 1) & (F.grouping(store) == 1), "total")
        .when(F.grouping(store) == 1, "product")
        .when(F.grouping(product) == 1, "store")
        .otherwise("product_store")
    )
    return df.groupingSets(sets, product, store, day).agg(
        level.alias("level"), *[F.sum(m).alias(m) for m in present]
    )


def pivot_sum(df: DataFrame, index: str, on: str, values: Sequence, measure: str) -> DataFrame:
    """One row per ``index`` and one column per listed value of ``on``."""
    return df.groupBy(index).pivot(on, list(values)).agg(F.sum(measure))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def min_max_scaled(df: DataFrame, column: str, offset: float = 0.0) -> Column:
    """``column`` scaled to [0, 1] over the whole table, plus ``offset``.

    Extremes are scalar subqueries: one small aggregate, no window over the whole table. All equal
    values scale to NULL.
    """
    low = df.agg(F.min(column)).scalar()
    high = df.agg(F.max(column)).scalar()
    return F.lit(offset) + F.try_divide(F.col(column) - low, high - low)


def describe_whole_units(df: DataFrame, column: str) -> DataFrame:
    """Count, nulls, mean, std, min, quartiles and max of a column of whole numbers.

    The quartile buffer counts distinct values, which whole units keep small.
    """
    x = F.col(column)
    return df.agg(
        F.count(x).alias("count"),
        F.count_if(x.isNull()).alias("null_count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, F.lit(0.25)).alias("q25"),
        F.percentile(x, F.lit(0.5)).alias("q50"),
        F.percentile(x, F.lit(0.75)).alias("q75"),
        F.max(x).alias("max"),
    )


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of several columns of one row, NULLs left out."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(known))
