"""Mixing sources to target weights with a curriculum that changes over training time.

Training time runs from 0 to 1. Each source has a weight schedule, linear between its points; the schedules repeat
over the sources in code-point order, null last. The integral of a schedule is the source's weight: sources share
``volume`` times all words by weight, no target is above ``most_repeats`` times its source's words, and what
is cut off there is shared again by weight among the others until none is above.

The demand of a source up to time t is its target times the schedule's integral up to t over the whole integral.
Documents stand in a fixed random order (md5 of the id), as often as the target asks for; the words before the
middle of an occurrence, put into the inverted demand, give its training position. Range-sorting by position
gives the training order. The last occurrence of a source takes only the first words that are still wanted,
so a source's taken words equal its target rounded down.

How it scales: texts are read once, for their number of words. Running totals within a source are made in
``BUCKETS`` buckets of the order, from bucket sums, so that a hot source is spread like all others; targets are found
in rounds of one aggregate over the sources. Nothing is collected but two sums a round.

A null text has no words: size 0, taken 0. Null is a source of its own. Equal rows stand beside each other and share
what is taken in any order; the rows of the result are the same in each run. A source without words has target 0.
An empty table gives no rows. Columns of the result do not clash with other columns of the input, which are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restock.operators.running import bucketed_running_total
from restock.session import cut_lineage

#: (time, weight) points of the repeating schedules; their integrals are 3, 1 and 2
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
VOLUME, MOST_REPEATS = 1.5, 2
HEX_DIGITS = 3
BUCKETS = 16**HEX_DIGITS
SOURCE_RANGES = 64
WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]


def segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(integral before, time, weight, slope) of each stretch between two points."""
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 <= t0:
            raise ValueError("times of a schedule rise")
        out.append((before, t0, w0, (w1 - w0) / (t1 - t0)))
        before += (w0 + w1) / 2 * (t1 - t0)
    return out


def integral(schedule: Schedule) -> float:
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, filled: Column) -> Column:
    """The time at which the schedule's integral reaches ``filled`` (0 up to the whole integral)."""
    time = F.lit(None).cast("double")
    for before, start, weight, slope in reversed(segments(schedule)):
        rest = filled - F.lit(before)
        root = F.lit(weight) + F.sqrt(F.lit(weight) * F.lit(weight) + F.lit(2 * slope) * rest)
        here = F.lit(start) + F.coalesce(F.try_divide(F.lit(2.0) * rest, root), F.lit(0.0))
        time = F.when(rest >= 0, F.when(time.isNull(), here).otherwise(time)).otherwise(time)
    return F.least(time, F.lit(1.0))


def source_targets(sources: DataFrame, weights: Sequence[float], volume: float, most_repeats: float) -> DataFrame:
    """``sources`` (place from 0 on, size) with ``target``: shares by weight, capped, the excess shared again."""
    weight = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        weight = F.when(F.col("place") % len(weights) == k, F.lit(float(w))).otherwise(weight)
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(most_repeats)))
    total, open_weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    wanted = volume * (total or 0)
    capped = 0.0
    while open_weight:
        over = F.col("weight") * F.lit(wanted - capped) / F.lit(open_weight) > F.col("most")
        now, left = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if left == open_weight:
            break
        capped, open_weight = now, left
    if not open_weight:
        return sources.withColumn("target", F.col("most"))
    return sources.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(wanted - capped) / F.lit(open_weight)))


def assign_positions(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, volume: float = VOLUME, most_repeats: float = MOST_REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken, occurrences array<struct<position, words>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("none"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"),
        ).withColumn("bucket", F.substring("key", 1, HEX_DIGITS))
    )
    group = ["none", "source"]
    buckets = cut_lineage(rows.groupBy(*group, "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = buckets.groupBy(*group).agg(F.sum("bucket_size").alias("size"))
    # a source's place: range buckets, so that no task sorts all sources
    ranged = cut_lineage(
        sources.repartitionByRange(SOURCE_RANGES, *group).select(*group, "size", F.lit(1).alias("one"), F.spark_partition_id().alias("part"))
    )
    placed = bucketed_running_total(ranged, [], ["part"], group, "one", "place").withColumn("place", F.col("place") - 1)
    weights = [integral(s) for s in schedules]
    targets = source_targets(cut_lineage(placed.select(*group, "size", "place")), weights, volume, most_repeats)

    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(targets.select(*group, F.col("size").alias("source_size"), "target", "place"), group)
        .drop("bucket_size")
    )
    inside = Window.partitionBy(*group, "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, [*group, "bucket"])
        .withColumn("before", F.col("before") + F.col("inside"))
    )

    def occurrence(copy: Column) -> Column:
        start = copy * F.col("source_size") + F.col("before")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start))
        middle = (start + words / F.lit(2)) / F.col("target")
        position = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            here = inverse(schedule, middle * F.lit(weights[k]))
            position = F.when(F.col("place") % len(schedules) == k, here).otherwise(position)
        return F.struct(position.alias("position"), words.cast("long").alias("words"))

    copies = F.array(*(F.when(F.col("target") > 0, occurrence(F.lit(c))) for c in range(-int(-most_repeats // 1))))
    return laid.withColumn("occurrences", F.filter(copies, lambda o: F.coalesce(o["words"], F.lit(0)) > 0)).select(
        "doc_id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.expr("reduce(occurrences, 0L, (sum, o) -> sum + o.words)").alias("taken"), "occurrences",
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per occurrence in the order of training: position, doc_id, source, copy (from 0), words."""
    rows = assigned.select("doc_id", "source", F.posexplode("occurrences").alias("copy", "o"))
    rows = rows.select("o.position", "doc_id", "source", "copy", "o.words")
    keys = ["position", "doc_id", "copy"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def by_first_position(assigned: DataFrame) -> DataFrame:
    """Documents in the order of their first occurrence, unused ones last, as ``first_position``."""
    rows = assigned.withColumn("first_position", F.get("occurrences", F.lit(0))["position"]).drop("occurrences")
    order = [F.asc_nulls_last("first_position"), F.asc("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
