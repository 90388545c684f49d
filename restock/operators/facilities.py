"""Which depots to open and what to send from where: a plan with a lower bound on the cost of any.

Customers have a price that they pay for a unit. A depot would serve whoever pays most above the sending
cost until it is full, and opens if that covers its opening cost. For any prices, all demand at its price less what the
depots would gain is a lower bound on the cost (Lagrange duality). Customers that are not served by any depot raise
their price, those that several would serve lower it; the best bound is kept.

The plan opens the depots that gain at the best prices. A full depot charges what its last served customer pays above
the sending cost, so that others turn to it only if it is worth it; customers are allocated by cost with that charge.
Who is left over opens further depots, and a depot whose customers other depots can take for less than its
opening cost closes, the one that saves most first.

A depot's order is cut into STEPS price steps, so that one with most customers is spread over tasks. Rounds are staged.
Joins by customer shuffle at every size (``by_customer``): broadcasts of every round would add up in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.operators.network import allocate_demand
from restock.operators.running import bucketed_running_total
from restock.session import cut_lineage, drop_staged

STEPS = 4096


@dataclass(frozen=True)
class Opening:
    """``depots`` (warehouse_id, used), ``shipped`` (customer_id, warehouse_id, amount), cost parts, lower bound."""

    depots: DataFrame
    shipped: DataFrame
    sending: float
    opening: float
    unserved: float
    bound: float

    @property
    def cost(self) -> float:
        return self.sending + self.opening + self.unserved


def by_customer(df: DataFrame) -> DataFrame:
    """``df``, with a few rows of each customer, as the side of a join that is hashed after the shuffle."""
    return df.hint("shuffle_hash")


def _served(links: DataFrame, prices: DataFrame, unserved_cost: float) -> DataFrame:
    """What each depot would send to whom at the customers' prices: customer_id, warehouse_id, margin, amount, ..."""
    margin = F.col("pay") - F.col("unit_cost")
    ready = (
        links.join(by_customer(prices.select("customer_id", "pay")), "customer_id")
        .withColumn("margin", margin)
        .where("margin > 0")
        .withColumns({"turn": -F.col("margin"), "step": F.floor(F.col("margin") * F.lit(-STEPS / unserved_cost))})
    )
    total = bucketed_running_total(ready, ["warehouse_id"], ["step"], ["turn", "customer_id"], "demand", "upto")
    amount = F.least(F.col("demand"), F.col("capacity") - (F.col("upto") - F.col("demand")))
    return total.withColumn("amount", amount).where("amount > 0")


def customer_prices(links: DataFrame, unserved_cost: float, rounds: int) -> tuple[DataFrame, float]:
    """(warehouse_id, charge, gain) at the best prices found, and their bound."""
    spark = links.sparkSession
    start = F.least(F.min(F.col("unit_cost") + F.col("opening_cost") / F.col("capacity")), F.lit(unserved_cost))
    prices = cut_lineage(links.groupBy("customer_id").agg(F.max("demand").alias("demand"), start.alias("pay"), F.lit(0.0).alias("drift")))
    best, best_depots, step, idle = float("-inf"), None, 0.5, 0
    for turn in range(rounds + 1):
        served = cut_lineage(_served(links, prices, unserved_cost).select("customer_id", "warehouse_id", "margin", "amount", "capacity", "opening_cost"))
        full = F.sum("amount") >= F.max("capacity")
        depots = cut_lineage(
            served.groupBy("warehouse_id").agg(
                (F.sum(F.col("amount") * F.col("margin")) - F.max("opening_cost")).alias("gain"),
                F.when(full, F.min("margin")).otherwise(0.0).alias("charge"),
            )
        )
        given = (
            served.join(depots.where("gain > 0").select("warehouse_id"), "warehouse_id", "left_semi")
            .groupBy("customer_id")
            .agg(F.sum("amount").alias("got"))
        )
        missing = (F.col("demand") - F.coalesce("got", F.lit(0))).cast("double")
        drift = missing if turn == 0 else 0.7 * missing + 0.3 * F.col("drift")
        now = cut_lineage(prices.join(by_customer(given), "customer_id", "left").select("customer_id", "demand", "pay", drift.alias("drift")))
        gains = depots.where("gain > 0").agg(F.coalesce(F.sum("gain"), F.lit(0.0)))
        held = (F.col("pay") >= unserved_cost) & (F.col("drift") > 0)
        at = now.agg(
            (F.coalesce(F.sum(F.col("demand") * F.col("pay")), F.lit(0.0)) - gains.scalar()).alias("bound"),
            F.sum(F.when(held, 0.0).otherwise(F.col("drift") * F.col("drift") / F.col("demand"))).alias("length"),
        ).first()
        drop_staged(spark, served)
        if at.bound > best:
            best, best_depots, idle = at.bound, depots, 0
        else:
            idle += 1
            if idle % 2 == 0:
                step *= 0.5
        if not at.length or turn == rounds:
            break
        ahead = step * (best + 0.05 * abs(best) - at.bound) / at.length
        pay = F.col("pay") + F.lit(ahead) * F.col("drift") / F.col("demand")
        prices = now.withColumn("pay", F.greatest(F.lit(0.0), F.least(F.lit(unserved_cost), pay)))
    return best_depots, float(best)


def _rest(demands: DataFrame, shipped: DataFrame) -> DataFrame:
    got = shipped.groupBy("customer_id").agg(F.sum("amount").alias("got"))
    left = F.col("demand") - F.coalesce("got", F.lit(0))
    return demands.join(by_customer(got), "customer_id", "left").select("customer_id", left.alias("demand")).where("demand > 0")


def _free(depots: DataFrame, shipped: DataFrame) -> DataFrame:
    """``depots`` with the capacity that ``shipped`` leaves, and what is used of each."""
    used = shipped.groupBy("warehouse_id").agg(F.sum("amount").alias("used"))
    return depots.join(used, "warehouse_id", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn(
        "capacity", F.col("capacity") - F.col("used")
    )


def _close_one(shipped: DataFrame, depots: DataFrame, costs: DataFrame) -> DataFrame | None:
    """``shipped`` without the depot whose closing saves most, or None if no closing saves anything."""
    free = cut_lineage(_free(depots, shipped))
    spare = free.where("used > 0 and capacity > 0").select(F.col("warehouse_id").alias("other"), "capacity")
    ways = costs.select("customer_id", F.col("warehouse_id").alias("other"), F.col("unit_cost").alias("other_cost")).join(spare, "other")
    here = by_customer(shipped).join(costs, ["customer_id", "warehouse_id"])
    cheapest = (
        here.join(ways.hint("merge"), "customer_id", "left")
        .where(F.col("other").isNull() | (F.col("other") != F.col("warehouse_id")))
        .groupBy("customer_id", "warehouse_id", "amount", "unit_cost")
        .agg(F.min("other_cost").alias("other_cost"))
    )
    # at least what closing costs: every unit goes to the cheapest other depot with room
    moved = here.join(by_customer(cheapest.select("customer_id", "warehouse_id", "other_cost")), ["customer_id", "warehouse_id"], "left")
    worth = (
        moved.groupBy("warehouse_id")
        .agg(F.bool_or(F.col("other_cost").isNull()).alias("stuck"), F.sum(F.col("amount") * (F.col("other_cost") - F.col("unit_cost"))).alias("extra"))
        .where("not stuck")
        .join(free, "warehouse_id")
        .withColumn("saving", F.col("opening_cost") - F.col("extra"))
        .where((F.col("saving") > 0) & (F.col("used") <= spare.agg(F.sum("capacity")).scalar() - F.col("capacity")))
    )
    # all that can save anything are tried, in turn
    tries = cut_lineage(worth.select("warehouse_id", "saving")).orderBy(F.desc("saving"), "warehouse_id")
    for row in tries.toLocalIterator():
        mine = cut_lineage(shipped.where(F.col("warehouse_id") == row.warehouse_id))
        room = free.where((F.col("used") > 0) & (F.col("warehouse_id") != row.warehouse_id)).withColumn("opening_cost", F.lit(0.0))
        orders = mine.groupBy("customer_id").agg(F.sum("amount").alias("demand"))
        again = cut_lineage(allocate_demand(orders, room.select("warehouse_id", "capacity", "opening_cost"), costs))
        sent = lambda df: by_customer(df).join(costs, ["customer_id", "warehouse_id"]).agg(F.sum("amount"), F.sum(F.col("amount") * F.col("unit_cost"))).first()
        (units, before), (moved_units, after) = sent(mine), sent(again)
        fee = free.where(F.col("warehouse_id") == row.warehouse_id).first().opening_cost
        if units == moved_units and after - before < fee - 1e-9:
            both = shipped.where(F.col("warehouse_id") != row.warehouse_id).unionByName(again)
            return cut_lineage(both.groupBy("customer_id", "warehouse_id").agg(F.sum("amount").alias("amount")))
        drop_staged(shipped.sparkSession, mine)
        drop_staged(shipped.sparkSession, again)
    return None


def open_and_allocate(
    demands: DataFrame, warehouses: DataFrame, costs: DataFrame, unserved_cost: float | None = None, rounds: int = 20
) -> Opening:
    """``demands``: customer_id, demand; ``warehouses``: warehouse_id, capacity, opening_cost; ``costs``: customer_id,
    warehouse_id, unit_cost. A unit that is not served costs ``unserved_cost`` (default: twice the dearest way)."""
    demands = cut_lineage(demands.select("customer_id", F.col("demand").cast("long").alias("demand")).where("demand > 0"))
    depots = cut_lineage(
        warehouses.select("warehouse_id", F.col("capacity").cast("long").alias("capacity"), F.col("opening_cost").cast("double").alias("opening_cost"))
        .where("capacity > 0")
    )
    costs = cut_lineage(costs.select("customer_id", "warehouse_id", F.col("unit_cost").cast("double").alias("unit_cost")))
    links = cut_lineage(costs.join(by_customer(demands), "customer_id").join(depots, "warehouse_id"))
    if unserved_cost is None:
        unserved_cost = 2 * (links.agg(F.max(F.col("unit_cost") + F.col("opening_cost") / F.col("capacity"))).first()[0] or 0.0) + 1
    reachable = links.select("customer_id").distinct()
    lost = demands.join(by_customer(reachable), "customer_id", "left_anti").agg(F.coalesce(F.sum("demand"), F.lit(0))).first()[0]
    gains, bound = customer_prices(links, float(unserved_cost), rounds)
    charged = cut_lineage(
        depots.join(gains, "warehouse_id", "left").select(
            "warehouse_id", "capacity", (F.coalesce("charge", F.lit(0.0)) * F.col("capacity")).alias("charged"), "opening_cost",
            (F.coalesce("gain", F.lit(-1.0)) > 0).alias("opens"),
        )
    )
    as_fee = lambda df, fee: df.select("warehouse_id", "capacity", F.col(fee).alias("opening_cost"))
    shipped = cut_lineage(allocate_demand(demands, as_fee(charged.where("opens"), "charged"), costs))
    rest = cut_lineage(_rest(demands, shipped))
    if not rest.isEmpty():
        more = allocate_demand(rest, as_fee(_free(depots, shipped), "opening_cost"), costs)
        both = shipped.unionByName(more)
        shipped = cut_lineage(both.groupBy("customer_id", "warehouse_id").agg(F.sum("amount").alias("amount")))
    while (fewer := _close_one(shipped, depots, costs)) is not None:
        shipped = fewer
    used = shipped.groupBy("warehouse_id").agg(F.sum("amount").alias("used"))
    sending = by_customer(shipped).join(costs, ["customer_id", "warehouse_id"]).agg(F.coalesce(F.sum(F.col("amount") * F.col("unit_cost")), F.lit(0.0))).first()[0]
    opening = depots.join(used, "warehouse_id").agg(F.coalesce(F.sum("opening_cost"), F.lit(0.0))).first()[0]
    open_units = _rest(demands, shipped).agg(F.coalesce(F.sum("demand"), F.lit(0))).first()[0]
    return Opening(used, shipped, sending, opening, float(open_units * unserved_cost), bound + float(lost * unserved_cost))
