"""A shipping plan: what goes from which warehouse to which store in which van, and who drives.

1. Demands and stocks of a product are laid end to end; where two stretches overlap, that warehouse sends to that store.
2. All that one warehouse sends to one store is a lane, cut into trips of equal capacity. That capacity is the
   smallest among the vans in use, which are the largest ones; their number is the smallest for which all trips fit
   into ``trip_limit`` trips a van and no lane needs a van twice.
3. Trips are numbered lane by lane and dealt to the vans in turn, so a van never sees a lane twice.
4. Employees are paired in random order. Pairs on the conflict list part and are paired again, with others that are left.

Everything is prefix sums over sorted ranges and equi-joins. Only the choice of the number of vans is made in
the driver, by bisection over one aggregate a step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restock.operators.running import bucketed_running_total, salt
from restock.session import cut_lineage

BUCKETS = 256
LANE = ["warehouse", "store"]


@dataclass(frozen=True)
class ShippingPlan:
    """``shipments`` (product, warehouse, store, vehicle, boxes), ``crew`` (vehicle, employee), the number of vans used
    and the least number that could carry all boxes by volume."""

    shipments: DataFrame
    crew: DataFrame
    vans: int
    least_vans: int


def flows(demands: DataFrame, stocks: DataFrame) -> DataFrame:
    """(product, warehouse, store, boxes): stock is sent to demand in order; what stock cannot meet stays open."""

    def laid(df: DataFrame, who: str, amount: str) -> DataFrame:
        past = Window.partitionBy("product").orderBy(who).rowsBetween(Window.unboundedPreceding, -1)
        return df.where(F.col(amount) > 0).select("product", F.coalesce(F.sum(amount).over(past), F.lit(0)).alias("at"), who, amount)

    stores = laid(demands, "store", "demand")
    depots = laid(stocks, "warehouse", "stock")
    ends = (
        stores.groupBy("product").agg(F.sum("demand").alias("d"))
        .join(depots.groupBy("product").agg(F.sum("stock").alias("s")), "product")
        .select("product", F.least("d", "s").alias("end"))
    )
    # a stretch begins wherever a store's or a warehouse's does, and lasts until the next one
    starts = stores.drop("demand").unionByName(depots.drop("stock"), allowMissingColumns=True)
    order = Window.partitionBy("product").orderBy("at", F.col("store").isNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        starts.join(ends, "product")
        .select(
            "product",
            F.last("warehouse", ignorenulls=True).over(so_far).alias("warehouse"),
            F.last("store", ignorenulls=True).over(so_far).alias("store"),
            (F.least("end", F.coalesce(F.lead("at").over(order), F.col("end"))) - F.col("at")).cast("long").alias("boxes"),
        )
        .where("boxes > 0")
    )


def _fleet(lanes: DataFrame, vans: DataFrame, trip_limit: int) -> tuple[DataFrame, int, int]:
    """Vans in use (vehicle, turn from 0 on), the boxes of a trip, and the least number of vans by volume."""
    ranked = cut_lineage(
        bucketed_running_total(
            vans.where("capacity > 0").withColumns({"size": -F.col("capacity"), "salt": salt(["vehicle"], BUCKETS), "one": F.lit(1)}),
            [], ["size", "salt"], ["vehicle"], "one", "turn",
        ).withColumn("turn", F.col("turn") - 1)
    )
    volume = bucketed_running_total(ranked, [], ["size", "salt"], ["vehicle"], "capacity", "carried")
    total = lanes.agg(F.coalesce(F.sum("boxes"), F.lit(0))).first()[0]
    least = volume.where(F.col("carried") * trip_limit >= total).agg(F.min("turn")).first()[0]
    count = ranked.count()
    if not total:
        return ranked.limit(0), 1, 0
    if least is None:
        raise ValueError("the vans cannot carry all boxes within the trip limit")

    def trips(n: int) -> tuple[int, int]:
        """The boxes of a trip with the n largest vans, and the trips that are missing (0 or less: all fit)."""
        size = ranked.where(F.col("turn") == n - 1).first().capacity
        need = lanes.agg(F.sum(F.ceil(F.col("boxes") / size)), F.max(F.ceil(F.col("boxes") / size))).first()
        return size, max(need[0] - n * trip_limit, need[1] - n)

    low, high = least, count  # vans known to be too few, and known to do
    if trips(count)[1] > 0:
        raise ValueError("trips of equal size do not fit; raise the trip limit")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if trips(middle)[1] <= 0 else (middle, high)
    return ranked.where(F.col("turn") < high), trips(high)[0], least + 1


def crews(vans: DataFrame, employees: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(vehicle, employee): two for each van that are not in ``conflicts`` (e1, e2), either way round."""
    spark = vans.sparkSession
    bad = cut_lineage(conflicts.select(F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b")).distinct())
    vans = cut_lineage(vans.select("vehicle"))
    free = cut_lineage(employees.select("employee").distinct())

    def numbered(df: DataFrame, key: str, name: str, draw: int) -> DataFrame:
        shuffled = df.withColumns({"one": F.lit(1), "h": F.xxhash64(F.lit(draw), key)}).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
        return bucketed_running_total(shuffled, [], ["bucket"], ["h", key], "one", name).select(key, (F.col(name) - 1).alias(name))

    done, idle = [], 0
    for draw in range(1000):
        placed = numbered(free, "employee", "place", draw)
        pairs = placed.groupBy(F.expr("place div 2").alias("n")).agg(F.min("employee").alias("a"), F.max("employee").alias("b"), F.count("*").alias("k"))
        good = pairs.where("k = 2").join(bad, ["a", "b"], "left_anti")
        waiting = numbered(vans, "vehicle", "n", 0)
        chosen = cut_lineage(
            numbered(good.select("a", "b"), "a", "n", draw).join(good.select("a", "b"), "a").join(waiting, "n").select("vehicle", "a", "b")
        )
        done.append(chosen.select("vehicle", F.explode(F.array("a", "b")).alias("employee")))
        vans = cut_lineage(vans.join(chosen, "vehicle", "left_anti"))
        if vans.isEmpty():
            break
        idle = idle + 1 if chosen.isEmpty() else 0
        free = cut_lineage(free.join(done[-1], "employee", "left_anti"))
        if idle == 5:
            raise ValueError("too few employees that get on with each other")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return cut_lineage(result)


def shipping_plan(
    demands: DataFrame, stocks: DataFrame, vans: DataFrame, employees: DataFrame, conflicts: DataFrame, trip_limit: int
) -> ShippingPlan:
    """``demands``: product, store, demand; ``stocks``: product, warehouse, stock; ``vans``: vehicle, capacity; ``employees``:
    employee; ``conflicts``: e1, e2. Repeated demands and stocks of a key add up."""
    demands = demands.groupBy("product", "store").agg(F.sum("demand").cast("long").alias("demand"))
    stocks = stocks.groupBy("product", "warehouse").agg(F.sum("stock").cast("long").alias("stock"))
    sent = cut_lineage(flows(demands, stocks))
    lanes = cut_lineage(sent.groupBy(*LANE).agg(F.sum("boxes").alias("boxes")))
    fleet, size, least = _fleet(lanes, vans, trip_limit)
    fleet = cut_lineage(fleet.select("vehicle", "turn"))
    n = fleet.count()
    if not n:
        empty = sent.select("product", *LANE, F.lit(None).cast(vans.schema["vehicle"].dataType).alias("vehicle"), "boxes")
        return ShippingPlan(empty, fleet.select("vehicle").join(employees.select("employee").limit(0), how="cross"), 0, 0)
    counted = lanes.withColumns({"trips": F.ceil(F.col("boxes") / size), "salt": salt(LANE, BUCKETS)})
    first = bucketed_running_total(counted, [], ["salt"], LANE, "trips", "upto").select(*LANE, (F.col("upto") - F.col("trips")).alias("first"))
    inside = bucketed_running_total(sent.withColumn("salt", salt(["product"], BUCKETS)), LANE, ["salt"], ["product"], "boxes", "upto")
    start = F.col("upto") - F.col("boxes")
    parts = (
        inside.select("product", *LANE, start.alias("low"), F.col("upto").alias("high"))
        .withColumn("trip", F.explode(F.sequence(F.expr(f"low div {size}"), F.expr(f"(high - 1) div {size}"))))
        .withColumn("boxes", F.least("high", (F.col("trip") + 1) * size) - F.greatest("low", F.col("trip") * size))
    )
    shipments = (
        parts.join(first, LANE)
        .withColumn("turn", (F.col("first") + F.col("trip")) % n)
        .join(fleet, "turn")
        .select("product", *LANE, "vehicle", "boxes")
    )
    return ShippingPlan(cut_lineage(shipments), crews(fleet, employees, conflicts), n, least)
