"""Paths, assignments, groupings and allocations computed in rounds of joins and aggregates.

Every round is one staged job over the whole state, and each loop ends when its frontier is empty.
Per-key minima are combined before the shuffle, so a node or resource with many rows stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restock.operators.running import bucketed_running_total
from restock.session import cut_lineage, drop_staged

RANGES = 64
DRAWS = 4


# --- budget-limited shortest path --------------------------------------------------------------


def budget_path_states(edges: DataFrame, source: int, budget: int) -> DataFrame:
    """Least distance to reach each node having spent exactly ``spent``, for spent <= budget.

    ``edges``: src, dst, distance, cost with whole, non-negative weights. The state is bounded by
    nodes × (budget + 1); only improved states go into the next round, so the result is exact.
    """
    spark = edges.sparkSession
    roads = cut_lineage(
        edges.filter((F.col("cost") <= budget) & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst", "cost")
        .agg(F.min("distance").alias("distance"))
    )
    start = spark.range(1).select(
        F.lit(source).cast("long").alias("node"), F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("total")
    )
    best = frontier = cut_lineage(start)
    while not frontier.isEmpty():
        reached = (
            frontier.join(roads, F.col("node") == F.col("src"))
            .select(
                F.col("dst").cast("long").alias("node"),
                (F.col("spent") + F.col("cost")).cast("long").alias("spent"),
                (F.col("total") + F.col("distance")).cast("long").alias("total"),
            )
            .filter(F.col("spent") <= budget)
            .groupBy("node", "spent")
            .agg(F.min("total").alias("total"))
        )
        known = best.withColumnRenamed("total", "known")
        frontier = cut_lineage(
            reached.join(known, ["node", "spent"], "left")
            .filter(F.col("known").isNull() | (F.col("total") < F.col("known")))
            .drop("known")
        )
        best = cut_lineage(
            best.unionByName(frontier).groupBy("node", "spent").agg(F.min("total").alias("total"))
        )
    return best


def shortest_within_budget(states: DataFrame, target: int) -> DataFrame:
    """(total, spent) of the best way to ``target``; less spent wins a tie. Empty if unreachable."""
    return (
        states.filter(F.col("node") == target)
        .orderBy("total", "spent")
        .limit(1)
        .select("total", "spent")
    )


# --- greedy assignment -------------------------------------------------------------------------


def mutual_minima(rows: DataFrame, resources: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that come first in ``order`` for every one of their resources."""
    kept = rows.withColumn("_o", F.struct(*order))
    for resource in resources:
        first = rows.groupBy(resource).agg(F.min(F.struct(*order)).alias("_first"))
        kept = kept.join(first, resource).filter("_o = _first").drop("_first")
    return kept.select(*rows.columns)


def assignment_turn(ties: str = "hash") -> Column:
    """The place of a pair among pairs of equal cost: by a hash of the pair, or by its ids (``"id"``)."""
    if ties not in ("hash", "id"):
        raise ValueError(f"unknown tie order {ties}")
    return F.xxhash64("task", "worker") if ties == "hash" else F.lit(0).cast("long")


def greedy_assignment(costs: DataFrame, ties: str = "hash") -> DataFrame:
    """Cheapest-first matching of ``task`` to ``worker``.

    A pair that is cheapest for both sides is what the sequential greedy would take as well, so all
    such pairs are taken at once until nothing is left. With ties in hash order a level of equal costs
    takes about log n rounds; ``ties="id"`` (smaller task, then worker) may take one round a pair, and so may
    costs that rise strictly from pair to neighbouring pair.
    """
    spark = costs.sparkSession
    rest = cut_lineage(costs.select("task", "worker", "cost", assignment_turn(ties).alias("turn")))
    chosen = []
    while True:
        picked = cut_lineage(mutual_minima(rest, ["task", "worker"], ["cost", "turn", "task", "worker"]))
        if picked.isEmpty():
            break
        chosen.append(picked.drop("turn"))
        before = rest
        rest = cut_lineage(
            rest.join(picked.select("task"), "task", "left_anti").join(
                picked.select("worker"), "worker", "left_anti"
            )
        )
        drop_staged(spark, before)
    return reduce(DataFrame.unionByName, chosen) if chosen else rest.drop("turn")


def assignment_audit(costs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(check, value): tasks and workers used more than once or not at all, and the total cost."""
    checks = []
    for side in ("task", "worker"):
        uses = assigned.groupBy(side).agg(F.count("*").alias("uses"))
        counted = costs.select(side).distinct().join(uses, side, "left")
        checks.append(
            counted.agg(
                F.count_if(F.col("uses") > 1).alias(f"{side}_repeated"),
                F.count_if(F.col("uses").isNull()).alias(f"{side}_unused"),
            ).unpivot([], [f"{side}_repeated", f"{side}_unused"], "check", "value")
        )
    total = assigned.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("value")).select(
        F.lit("total_cost").alias("check"), "value"
    )
    return reduce(DataFrame.unionByName, [*checks, total])


# --- conflict-free grouping --------------------------------------------------------------------


def conflict_free_groups(conflicts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, group): no two nodes of a conflict ``(a, b)`` share a group.

    A node waits for its conflicting nodes of larger (degree, hash of the id, id) and then takes the smallest
    group none of them uses; the hash keeps chains of nodes of equal degree short. Valid, not minimal. The smallest free group is found by an anti-join on
    (node, group), so a node with many conflicts is spread over its groups.
    """
    pairs = conflicts.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = both.groupBy("a").agg(F.count("*").alias("deg"))
    rank = lambda side: F.struct(F.col(f"{side}.deg"), F.xxhash64(f"{side}.a"), F.col(f"{side}.a"))
    waits = (
        both.alias("e")
        .join(degree.alias("x"), F.col("e.a") == F.col("x.a"))
        .join(degree.alias("y"), F.col("e.b") == F.col("y.a"))
        .filter(rank("x") < rank("y"))
        .select(F.col("e.a").alias("node"), F.col("e.b").alias("other"), F.lit(None).cast("int").alias("taken"))
    )
    waits = cut_lineage(waits)
    everyone = both.select(F.col("a").alias("node"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col("node").cast("long")))
    free = cut_lineage(
        everyone.distinct()
        .join(waits.select("node").distinct(), "node", "left_anti")
        .withColumn("group", F.lit(0))
    )
    done = [free]
    while True:
        before = waits
        waits = cut_lineage(
            waits.join(free.select(F.col("node").alias("other"), "group"), "other", "left").select(
                "node", "other", F.coalesce("taken", "group").alias("taken")
            )
        )
        drop_staged(waits.sparkSession, before)
        ready = waits.groupBy("node").agg(F.count_if(F.col("taken").isNull()).alias("open")).filter("open = 0")
        used = waits.join(ready, "node", "left_semi").select("node", F.col("taken").alias("group")).distinct()
        options = (
            used.select("node", (F.col("group") + 1).alias("group"))
            .unionByName(used.select("node", F.lit(0).alias("group")))
            .distinct()
        )
        free = cut_lineage(
            options.join(used, ["node", "group"], "left_anti")
            .groupBy("node")
            .agg(F.min("group").alias("group"))
        )
        if free.isEmpty():
            break
        done.append(free)
        before, waits = waits, cut_lineage(waits.join(free.select("node"), "node", "left_anti"))
        drop_staged(waits.sparkSession, before)
    return reduce(DataFrame.unionByName, done)


def grouping_audit(conflicts: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes, distinct conflicts and conflicts inside one group."""
    g1 = groups.select(F.col("node").alias("a"), F.col("group").alias("ga"))
    g2 = groups.select(F.col("node").alias("b"), F.col("group").alias("gb"))
    pairs = conflicts.select(
        F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")
    ).filter("a != b").distinct()
    n_nodes = groups.agg(F.count("*")).scalar()
    return (
        pairs.join(g1, "a", "left")
        .join(g2, "b", "left")
        .agg(
            F.count("*").alias("n_conflicts"),
            F.count_if(F.col("ga").isNull() | F.col("gb").isNull()).alias("n_ungrouped"),
            F.count_if(F.col("ga") == F.col("gb")).alias("n_broken"),
        )
        .withColumn("n_nodes", n_nodes)
    )


# --- timetable ---------------------------------------------------------------------------------


def place_sessions(requirements: DataFrame) -> DataFrame:
    """(class, teacher, room, period) with every resource used at most once per period; a null is a resource like any other.

    Each round every open session draws periods by hash and bids for the first in which its class, teacher and room are
    all free; of the bids for a resource and period the smallest hash wins. A round draws DRAWS periods for each session
    of the input, shared among the open ones, and all periods once they are that few, so rounds grow with the logarithm
    of the sessions. Periods start at the largest number of sessions of a resource, which no timetable can do without,
    and a few are added each round, up to as many as always leave one free. Valid, not minimal.
    """
    resources, key = ["class", "teacher", "room"], ["class", "subject", "teacher", "room", "nth"]
    wanted = requirements.groupBy(*key[:-1]).agg(F.sum("times").alias("times"))
    one_by_one = wanted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rest = cut_lineage(one_by_one.select(*key, F.xxhash64(*key).alias("turn")))
    n = left = rest.count()
    loads = [rest.groupBy(r).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for r in resources]
    placed: list[DataFrame] = []
    draws, turn_of = DRAWS * n, F.struct("turn", *key)
    while left:
        periods = min(sum(loads) - 2, max(loads) + len(placed) * (1 + max(loads) // 50))
        each = min(periods, max(DRAWS, draws // left))
        draw = F.xxhash64("turn", *key, F.lit(len(placed)), "draw")
        period = F.col("draw") if each == periods else F.pmod(draw, F.lit(periods)).cast("int")
        tries = rest.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumns({"place": draw, "period": period})
        free = F.lit(True)
        for r in resources if placed else []:
            used = reduce(DataFrame.unionByName, placed).select(F.col(r).alias("_r"), F.col("period").alias("_p"), F.lit(True).alias(f"_{r}"))
            tries = tries.join(used, F.col(r).eqNullSafe(F.col("_r")) & (F.col("period") == F.col("_p")), "left").drop("_r", "_p")
            free &= F.col(f"_{r}").isNull()
        first = F.min(F.when(free, F.struct("place", "period")))
        bids = cut_lineage(tries.groupBy(*key, "turn").agg(first["period"].alias("period")))
        won = reduce(Column.__and__, [F.min(turn_of).over(Window.partitionBy(r, "period")) == turn_of for r in resources])
        judged = cut_lineage(bids.where("period is not null").withColumn("won", won))
        drop_staged(rest.sparkSession, rest)
        placed.append(judged.where("won").select(*key, "period"))
        rest = cut_lineage(judged.where("not won").drop("won", "period").unionByName(bids.where("period is null").drop("period")))
        before, left = left, rest.count()
        if left == before:
            draws *= 2
        drop_staged(rest.sparkSession, bids)
    return reduce(DataFrame.unionByName, placed) if placed else rest.select(*key, F.lit(0).alias("period"))


def timetable_audit(requirements: DataFrame, sessions: DataFrame, periods: int) -> DataFrame:
    """(check, violations) of a timetable: demands met, no resource twice in a period, range."""
    key = ["class", "teacher", "room"]
    wanted = requirements.groupBy(*key).agg(F.sum("times").alias("times"))
    held = sessions.groupBy(*key).agg(F.count("*").alias("held"))
    checks = [
        wanted.join(held, key, "full")
        .agg(F.count_if(F.coalesce("times", F.lit(0)) != F.coalesce("held", F.lit(0))).alias("violations"))
        .select(F.lit("requirement_met").alias("check"), "violations")
    ]
    for resource in key:
        clashes = sessions.groupBy(resource, "period").agg(F.count("*").alias("n"))
        checks.append(
            clashes.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
                F.lit(f"{resource}_clash").alias("check"), "violations"
            )
        )
    outside = (F.col("period") < 0) | (F.col("period") >= periods)
    checks.append(
        sessions.agg(F.count_if(outside).alias("violations")).select(
            F.lit("period_range").alias("check"), "violations"
        )
    )
    return reduce(DataFrame.unionByName, checks)


# --- capacitated allocation --------------------------------------------------------------------


def allocate_demand(demands: DataFrame, warehouses: DataFrame, costs: DataFrame) -> DataFrame:
    """(customer_id, warehouse_id, amount): demand split over warehouses within their capacity.

    ``demands``: customer_id, demand. ``warehouses``: warehouse_id, capacity, opening_cost.
    ``costs``: customer_id, warehouse_id, unit_cost. Each round every customer with open demand asks
    its cheapest warehouse that has capacity left (unit cost plus opening cost per unit of
    capacity); a warehouse serves its cheapest requests first, ties by customer. Not optimal. In each round a warehouse
    fills up or every request is met, so there are at most as many rounds as warehouses. Joins by customer shuffle
    at every size: a broadcast in each round would go through the driver.
    """
    depots = cut_lineage(warehouses.select("warehouse_id", F.col("capacity").cast("long"), "opening_cost"))
    open_links = costs.join(depots.filter("capacity > 0"), "warehouse_id").select(
        "customer_id",
        "warehouse_id",
        (F.col("unit_cost") + F.col("opening_cost") / F.col("capacity")).alias("score"),
    )
    links = cut_lineage(open_links)
    rest = cut_lineage(demands.select("customer_id", F.col("demand").cast("long").alias("rest")).filter("rest > 0"))
    free = depots.select("warehouse_id", F.col("capacity").alias("free")).filter("free > 0")
    nothing = links.filter("false").select("customer_id", "warehouse_id", F.lit(0).cast("long").alias("amount"))
    rounds = []
    while True:
        asked = (
            links.join(free.select("warehouse_id"), "warehouse_id", "left_semi")
            .join(rest.hint("shuffle_hash"), "customer_id")
            .groupBy("customer_id", "rest")
            .agg(F.min(F.struct("score", "warehouse_id")).alias("pick"))
            .select("customer_id", "rest", F.col("pick.score").alias("score"), F.col("pick.warehouse_id").alias("warehouse_id"))
            # ranges of equal size in the serving order, so a warehouse with most requests has many
            .repartitionByRange(RANGES, "warehouse_id", "score", "customer_id")
            .withColumn("part", F.spark_partition_id())
        )
        running = bucketed_running_total(
            cut_lineage(asked), ["warehouse_id"], ["part"], ["score", "customer_id"], "rest", "upto"
        ).join(free, "warehouse_id")
        amount = F.least(F.col("rest"), F.col("free") - (F.col("upto") - F.col("rest")))
        step = cut_lineage(
            running.select("customer_id", "warehouse_id", amount.cast("long").alias("amount")).filter("amount > 0")
        )
        if step.isEmpty():
            break
        rounds.append(step)
        # what is left goes on to the next round; earlier rounds are not read again
        rest = cut_lineage(_less(rest, "rest", step, "customer_id"))
        free = cut_lineage(_less(free, "free", step, "warehouse_id"))
    return reduce(DataFrame.unionByName, rounds) if rounds else nothing


def _less(left: DataFrame, column: str, shipped: DataFrame, key: str) -> DataFrame:
    """``left`` with the shipped amounts taken off; rows with nothing left go."""
    taken = shipped.groupBy(key).agg(F.sum("amount").alias("_taken"))
    return left.join(taken.hint("shuffle_hash"), key, "left").select(
        key, (F.col(column) - F.coalesce("_taken", F.lit(0))).alias(column)
    ).filter(F.col(column) > 0)


def allocation_summary(
    shipped: DataFrame, demands: DataFrame, warehouses: DataFrame, costs: DataFrame
) -> DataFrame:
    """Totals and rule checks of an allocation in one row."""
    per_customer = demands.join(
        shipped.groupBy("customer_id").agg(F.sum("amount").alias("got")), "customer_id", "left"
    ).fillna(0, ["got"])
    per_depot = warehouses.join(
        shipped.groupBy("warehouse_id").agg(F.sum("amount").alias("used")), "warehouse_id", "left"
    )
    sending = shipped.join(costs, ["customer_id", "warehouse_id"]).agg(
        F.coalesce(F.sum(F.col("amount") * F.col("unit_cost")), F.lit(0.0))
    )
    over = per_depot.agg(F.count_if(F.col("used") > F.col("capacity"))).scalar()
    opening = per_depot.filter("used > 0").agg(F.coalesce(F.sum("opening_cost"), F.lit(0.0))).scalar()
    return per_customer.agg(
        F.sum("demand").cast("long").alias("demand"),
        F.sum("got").cast("long").alias("shipped"),
        F.count_if(F.col("got") > F.col("demand")).alias("over_served"),
    ).withColumns(
        {
            "over_capacity": over,
            "sending_cost": sending.scalar(),
            "opening_cost": opening,
        }
    )


# --- shipments with vans and crews -------------------------------------------------------------


def shipment_audit(
    shipments: DataFrame,
    demands: DataFrame,
    stocks: DataFrame,
    vans: DataFrame,
    crew: DataFrame,
    trip_limit: int,
) -> DataFrame:
    """(check, violations) of a shipping plan.

    ``shipments``: product, warehouse, store, vehicle, boxes. ``demands``: product, store, demand.
    ``stocks``: product, warehouse, stock. ``vans``: vehicle, capacity. ``crew``: vehicle, employee.
    """
    boxes = shipments.filter("boxes > 0")
    served = boxes.groupBy("product", "store").agg(F.sum("boxes").alias("got"))
    taken = boxes.groupBy("product", "warehouse").agg(F.sum("boxes").alias("taken"))
    trips = boxes.groupBy("vehicle", "warehouse", "store").agg(F.sum("boxes").alias("load"))
    per_van = trips.groupBy("vehicle").agg(F.count("*").alias("trips"))
    staff = crew.groupBy("vehicle").agg(F.count("*").alias("staff"))
    fleet = vans.join(per_van, "vehicle", "left").join(staff, "vehicle", "left").fillna(0, ["trips", "staff"])
    needed = F.when(F.col("trips") > 0, 2).otherwise(0)

    def check(name: str, df: DataFrame, rule) -> DataFrame:
        return df.agg(F.count_if(rule).alias("violations")).select(F.lit(name).alias("check"), "violations")

    zero = F.lit(0)
    return reduce(
        DataFrame.unionByName,
        [
            check(
                "demand_met",
                demands.join(served, ["product", "store"], "full"),
                F.coalesce("demand", zero) != F.coalesce("got", zero),
            ),
            check(
                "stock_limit",
                taken.join(stocks, ["product", "warehouse"], "left"),
                F.col("taken") > F.coalesce("stock", zero),
            ),
            check("trip_load", trips.join(vans, "vehicle"), F.col("load") > F.col("capacity")),
            check("trip_limit", fleet, F.col("trips") > trip_limit),
            check("crew_size", fleet, F.col("staff") != needed),
            check(
                "employee_once",
                crew.groupBy("employee").agg(F.count_distinct("vehicle").alias("n")),
                F.col("n") > 1,
            ),
        ],
    )


def conflicted_vans(crew: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(vehicle, e1, e2): conflicting employees in the same van, found from the conflict list."""
    first = crew.select("vehicle", F.col("employee").alias("e1"))
    second = crew.select("vehicle", F.col("employee").alias("e2"))
    return conflicts.join(first, "e1").join(second, ["vehicle", "e2"]).select("vehicle", "e1", "e2")
