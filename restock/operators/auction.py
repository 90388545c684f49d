"""Minimum-cost assignment by an auction in rounds, with a bound from its prices.

All open bidders (the side with fewer members) bid at once: each for the object that costs it least, price
included, and as much more as it could pay before its second-best choice (or staying open) were as good, plus
epsilon. An object goes to its highest bid, and who held it is open again. At the end every bidder is within
epsilon of its best choice, so cost and dual bound differ by at most bidders x epsilon. With as many objects
as bidders epsilon starts large and shrinks from phase to phase, each from the prices of the last one, which ends price
wars early; otherwise prices start at zero, because an object that nobody takes must end with price zero.

A round is two staged tables; per-object and per-bidder choices are combined before the shuffle. Tables of pairs are
dealt to as many tasks as they have ROWS_IN_TASK rows, so a task's hash tables and sorts do not grow with the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restock.session import cut_lineage, drop_staged

SHRINK = 5.0
ROWS_IN_TASK = 1_000_000


def _dealt(df: DataFrame, rows: float, *keys: str) -> DataFrame:
    """``df`` of about so many rows, at most about ROWS_IN_TASK of them in a task; small tables stay as they are."""
    if rows <= ROWS_IN_TASK:
        return df
    return df.repartition(max(ceil(rows / ROWS_IN_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


@dataclass(frozen=True)
class Auction:
    """``assigned`` (task, worker, cost); its cost with ``open_cost`` for each open bidder; lower bound on any."""

    assigned: DataFrame
    cost: float
    bound: float
    epsilon: float
    bidders: int


def _bids(costs: DataFrame, objects: DataFrame, bidders: DataFrame, open_cost: float, epsilon: float, rows: float = 0) -> DataFrame:
    """Best object, its cost with price, and the bid of each given bidder, who have about ``rows`` pairs; no object: it stays open."""
    value = F.col("cost") + F.coalesce("price", F.lit(0.0))
    turn = F.xxhash64("bidder", "object")
    by_value = Window.partitionBy("bidder").orderBy("value", "turn", "object")
    priced = _dealt(costs.join(bidders, "bidder", "left_semi"), rows, "object").join(objects.select("object", "price"), "object", "left")
    best_two = (
        _dealt(priced.select("bidder", "object", "cost", value.alias("value"), turn.alias("turn")), rows, "bidder")
        .withColumn("place", F.row_number().over(by_value))
        .where("place <= 2")
        .groupBy("bidder")
        .agg(
            F.min_by(F.struct("object", "cost", "value"), "place").alias("best"),
            F.max(F.when(F.col("place") == 2, F.col("value"))).alias("second"),
        )
    )
    limit = F.least(F.coalesce("second", F.lit(open_cost)), F.lit(open_cost))
    return best_two.select(
        "bidder",
        F.when(F.col("best.value") < open_cost, F.col("best.object")).alias("object"),
        (limit - F.col("best.cost") + epsilon).alias("bid"),
    )


def _phase(costs: DataFrame, everyone: DataFrame, prices: DataFrame, open_cost: float, epsilon: float, rows: int, n: int) -> DataFrame:
    """(object, price, holder) when none of the ``n`` bidders, who have ``rows`` pairs, wants to bid any more."""
    spark = costs.sparkSession
    objects = cut_lineage(prices.select("object", "price", F.lit(None).cast("long").alias("holder")))
    staying: DataFrame | None = None
    left = n  # at most as many bid as in the round before: who lost and who was outbid
    while True:
        waiting = everyone.join(objects.select(F.col("holder").alias("bidder")), "bidder", "left_anti")
        if staying is not None:
            waiting = waiting.join(staying, "bidder", "left_anti")
        bids = cut_lineage(_bids(costs, objects, waiting, open_cost, epsilon, rows * left / max(n, 1)))
        counted = bids.agg(F.count("*").alias("n"), F.count_if(F.col("object").isNull()).alias("stay")).first()
        if not counted.n:
            return objects
        left = counted.n
        if counted.stay:
            more = bids.where("object is null").select("bidder")
            staying = cut_lineage(more if staying is None else staying.union(more))
        won = bids.where("object is not null").groupBy("object").agg(F.max(F.struct("bid", F.xxhash64("bidder").alias("turn"), "bidder")).alias("won"))
        before = objects
        objects = cut_lineage(
            objects.join(won, "object", "full").select(
                "object", F.coalesce("won.bid", "price").alias("price"), F.coalesce("won.bidder", "holder").alias("holder")
            )
        )
        drop_staged(spark, before)
        drop_staged(spark, bids)


def _bound(costs: DataFrame, objects: DataFrame, open_cost: float, rows: int) -> float:
    cheapest = (
        _dealt(costs, rows, "object").join(objects, "object", "left")
        .groupBy("bidder")
        .agg(F.least(F.min(F.col("cost") + F.coalesce("price", F.lit(0.0))), F.lit(open_cost)).alias("c"))
    )
    paid = objects.agg(F.coalesce(F.sum("price"), F.lit(0.0)))
    return cheapest.agg((F.coalesce(F.sum("c"), F.lit(0.0)) - paid.scalar()).alias("b")).first().b


def auction_assignment(
    costs: DataFrame, gap: float = 0.01, epsilon: float | None = None, open_cost: float | None = None
) -> Auction:
    """Assign tasks to workers (``costs``: task, worker, cost; a missing pair is not possible).

    Each task and worker is used at most once, and a member of the smaller side that stays open costs ``open_cost``
    (default: the dearest pair and 1). ``epsilon`` defaults to ``gap`` times the mean of the bidders' cheapest costs, so that the
    result costs at most 1 + ``gap`` times the least possible. Whole costs and epsilon below 1 / bidders give an optimum.
    Repeated pairs count once, with their least cost; costs are 0 or more.
    """
    lines = costs.select(F.col("task").cast("long").alias("task"), F.col("worker").cast("long").alias("worker"), "cost")
    least = F.min("cost").cast("double").alias("cost")
    each = cut_lineage(_dealt(lines, lines.count(), "task", "worker").groupBy("task", "worker").agg(least))
    sides = each.agg(
        F.count_distinct("task").alias("tasks"), F.count_distinct("worker").alias("workers"), F.max("cost").alias("top"), F.count("*").alias("rows")
    ).first()
    bidder, other = ("task", "worker") if sides.tasks <= sides.workers else ("worker", "task")
    pairs = each.select(F.col(bidder).alias("bidder"), F.col(other).alias("object"), "cost")
    n = min(sides.tasks, sides.workers)
    open_cost = float(open_cost if open_cost is not None else (sides.top or 0) + 1)
    cheapest = cut_lineage(pairs.groupBy("bidder").agg(F.min("cost").alias("c")))
    if epsilon is None:
        epsilon = max(gap * (cheapest.agg(F.avg("c")).first()[0] or 0.0), 1e-6)
    everyone = cheapest.select("bidder")
    zero = pairs.select("object").distinct().withColumn("price", F.lit(0.0))
    steps = [epsilon]
    if sides.tasks == sides.workers:
        while steps[0] * SHRINK < (sides.top or 0) / 4:
            steps.insert(0, steps[0] * SHRINK)
    prices = zero
    for step in steps:
        prices = _phase(pairs, everyone, prices, open_cost, step, sides.rows, n)
    if len(steps) > 1 and not prices.where("holder is null and price > 0").isEmpty():
        prices = _phase(pairs, everyone, zero, open_cost, epsilon, sides.rows, n)  # an object that nobody takes kept a price
    held = prices.where("holder is not null").select("object", F.col("holder").alias("bidder"))
    chosen = _dealt(pairs, sides.rows, "bidder", "object").join(held, ["bidder", "object"])
    total = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()
    kind = costs.schema["cost"].dataType
    assigned = chosen.select(
        F.col("bidder").cast(costs.schema[bidder].dataType).alias(bidder),
        F.col("object").cast(costs.schema[other].dataType).alias(other),
        F.col("cost").cast(kind).alias("cost"),
    ).select("task", "worker", "cost")
    cost = total.c + open_cost * (n - total.n)
    return Auction(assigned, cost, _bound(pairs, prices.select("object", "price"), open_cost, sides.rows), epsilon, n)
