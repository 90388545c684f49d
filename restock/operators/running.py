"""Running totals that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed_running_total(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """Running sum of ``value`` per ``group`` in the order (``bucket``, ``order``), as ``name``.

    A plain window would send a whole group to one task. Here bucket sums are pre-aggregated, a
    window over the few buckets of a group gives each bucket its offset, and the row-level window
    runs per bucket. ``bucket`` must have a bounded number of values per group, and the order
    columns must make the order total. The offsets meet the rows where the windows put them, not by way of the driver.
    """
    group, bucket, order = list(group), list(bucket), list(order)
    keys = group + bucket
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets.hint("shuffle_hash"), keys)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def salt(keys: Sequence[str], buckets: int):
    """A stable bucket number for a row key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))
