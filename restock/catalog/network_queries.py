"""Network queries: L8–L14."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from restock.catalog.registry import query, sql
from restock.operators import facilities, network, shipping
from restock.operators.auction import auction_assignment
from restock.session import cut_lineage, staged_once

# --- L8 ----------------------------------------------------------------------------------------

BUDGET = 30


def roads(core):
    """Nation flows as roads: distance and fuel cost are small whole numbers from line counts."""
    return core.nation_flows().select(
        "src",
        "dst",
        (1 + F.col("n_lines") % 37).cast("long").alias("distance"),
        (1 + F.col("line_sum") % 19).cast("long").alias("cost"),
    )


@query(
    "L8_budget_path_states",
    sql(
        "flows",
        "select node, spent, min(total) total from walk group by 1, 2",
        roads="select src, dst, 1 + n_lines % 37 distance, cast(1 + line_sum % 19 as bigint) cost from flows where src <> dst",
        walk=f"""select cast(0 as bigint) node, cast(0 as bigint) spent, cast(0 as bigint) total
 union select cast(dst as bigint), spent + cost, total + distance from walk join roads on src = node where spent + cost <= {BUDGET}""",
    ).replace("walk as materialized", "walk as"),
)
def _(core):
    return network.budget_path_states(roads(core), 0, BUDGET)


@query(
    "L8_shortest_within_budget",
    sql(
        "flows",
        "select total, spent from walk where node = 24 order by total, spent limit 1",
        roads="select src, dst, 1 + n_lines % 37 distance, cast(1 + line_sum % 19 as bigint) cost from flows where src <> dst",
        walk=f"""select cast(0 as bigint) node, cast(0 as bigint) spent, cast(0 as bigint) total
 union select cast(dst as bigint), spent + cost, total + distance from walk join roads on src = node where spent + cost <= {BUDGET}""",
    ).replace("walk as materialized", "walk as"),
)
def _(core):
    return network.shortest_within_budget(network.budget_path_states(roads(core), 0, BUDGET), 24)


# --- L9, L10 -----------------------------------------------------------------------------------


def part_supplier_lines(core):
    """Line prices of parts and suppliers, in cents; pairs repeat."""
    return core.raw("lineitem").select(
        F.col("l_partkey").alias("task"), F.col("l_suppkey").alias("worker"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost")
    )


def part_supplier_costs(core):
    """Cheapest line price of each part and supplier, in cents."""
    return part_supplier_lines(core).groupBy("task", "worker").agg(F.min("cost").alias("cost"))


COSTS_SQL = """select l_partkey task, l_suppkey worker, cast(min(round(l_extendedprice * 100)) as bigint) cost
 from lineitem group by 1, 2"""
# a matching is greedy when every unchosen pair loses to a chosen pair of the same task or worker
@query(
    "L9_greedy_assignment",
    sql(
        "",
        "select count(*) pairs, cast(0 as bigint) repeated, cast(0 as bigint) not_greedy from costs",
        costs=COSTS_SQL,
    ),
)
def _(core):
    """Property check: each pair is chosen or beaten by a chosen pair that shares a side."""
    costs = part_supplier_costs(core)
    chosen = network.greedy_assignment(costs)
    order = F.struct("cost", network.assignment_turn(), "task", "worker")
    by_task = chosen.select("task", order.alias("t"))
    by_worker = chosen.select("worker", order.alias("w"))
    judged = costs.join(by_task, "task", "left").join(by_worker, "worker", "left").withColumn("o", order)
    lost = F.coalesce(F.col("o") >= F.col("t"), F.lit(False)) | F.coalesce(F.col("o") >= F.col("w"), F.lit(False))
    repeated = (
        network.assignment_audit(costs, chosen)
        .filter(F.col("check").isin("task_repeated", "worker_repeated"))
        .agg(F.sum("value"))
        .scalar()
    )
    return judged.agg(F.count("*").alias("pairs"), F.count_if(~lost).alias("not_greedy")).withColumn(
        "repeated", repeated
    )


def regional_costs(core):
    """Mean line price, in cents, of what each supplier region sent to each customer region."""
    lines = (
        core.raw("lineitem")
        .join(core.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(core.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(core.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    )
    nation = core.raw("nation")
    to = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("task"))
    of = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("worker"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    cells = lines.join(to, "c_nationkey").join(of, "s_nationkey").groupBy("task", "worker")
    return cells.agg(cents.alias("cents"), F.count("*").alias("k")).select("task", "worker", F.expr("cents div k").alias("cost"))


@query("L9_greedy_pairs")
def _(core):
    """The assignment of the sequential greedy."""
    return network.greedy_assignment(part_supplier_costs(core))


@query("L9_auction_assignment")
def _(core):
    """Each supplier gets a part, at a total within 1 % of the least possible."""
    return auction_assignment(part_supplier_lines(core)).assigned


@query(
    "L9_auction_bound",
    sql("", "select least(count(distinct task), count(distinct worker)) bidders, cast(0 as bigint) repeated, true bound_holds, true gap_holds from costs", costs=COSTS_SQL),
)
def _(core):
    """Property check: nothing is used twice, the bound is one, and the gap is at most bidders x epsilon."""
    costs = part_supplier_lines(core)
    result = auction_assignment(costs)
    audit = network.assignment_audit(costs, result.assigned)
    return audit.agg(
        F.lit(result.bidders).cast("long").alias("bidders"),
        F.sum(F.when(F.col("check").isin("task_repeated", "worker_repeated"), F.col("value"))).alias("repeated"),
        F.lit(result.bound <= result.cost + 1e-6).alias("bound_holds"),
        F.lit(result.cost - result.bound <= result.bidders * result.epsilon + 1e-6).alias("gap_holds"),
    )


@query(
    "L9_region_assignment",
    sql(
        "",
        """select m.task, m.worker, m.cost from best, cells m where m.worker = list_extract(best.p, m.task + 1)""",
        cells="""select c.n_regionkey task, s.n_regionkey worker, cast(sum(cast(round(l_extendedprice * 100) as bigint)) // count(*) as bigint) cost
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
 join nation c on c.n_nationkey = c_nationkey join nation s on s.n_nationkey = s_nationkey group by 1, 2""",
        orders_of="""select [a.worker, b.worker, c.worker, d.worker, e.worker] p, a.cost + b.cost + c.cost + d.cost + e.cost total
 from cells a, cells b, cells c, cells d, cells e where a.task = 0 and b.task = 1 and c.task = 2 and d.task = 3 and e.task = 4
 and len(list_distinct([a.worker, b.worker, c.worker, d.worker, e.worker])) = 5""",
        best="select p from orders_of order by total, p limit 1",
    ),
)
def _(core):
    """The cheapest one-to-one supply between the regions, exact: costs are whole and epsilon is below 1 / 5."""
    return auction_assignment(regional_costs(core), epsilon=0.15).assigned


@query(
    "L10_assignment_audit",
    sql(
        "",
        """select 'task_repeated' as "check", cast(0 as bigint) as "value"
 union all select 'task_unused', cast(0 as bigint)
 union all select 'worker_repeated', count(*) from (select worker from best group by 1 having count(*) > 1)
 union all select 'worker_unused', count(*) from (select distinct worker from costs where worker not in (select worker from best))
 union all select 'total_cost', cast(sum(cost) as bigint) from best""",
        costs=COSTS_SQL,
        best="""select task, worker, cost from costs qualify row_number() over (partition by task order by cost, worker) = 1""",
    ),
)
def _(core):
    """Audit of the assignment that gives each task its cheapest worker."""
    costs = part_supplier_costs(core)
    best = costs.groupBy("task").agg(F.min(F.struct("cost", "worker")).alias("b")).select(
        "task", F.col("b.worker").alias("worker"), F.col("b.cost").alias("cost")
    )
    return network.assignment_audit(costs, best)


# --- L11, L12 ----------------------------------------------------------------------------------


def heavy_conflicts(core):
    """Nation pairs of a ship quarter that exchanged lines; nodes are per quarter."""
    cells = core.monthly_flows().withColumn("quarter", F.expr("(month_no - 1) div 3"))
    flows = cells.groupBy("quarter", "src", "dst").agg(F.sum("n_lines").alias("n")).filter("src != dst")
    node = lambda c: (F.col("quarter") * 100 + F.col(c)).cast("long")
    return flows.select(node("src").alias("a"), node("dst").alias("b"))


@query(
    "L11_conflict_free_groups",
    sql(
        "",
        """select count(*) n_conflicts, cast(0 as bigint) n_ungrouped, cast(0 as bigint) n_broken,
 (select count(distinct x) from (select a x from e union all select b from e)) n_nodes from (select distinct least(a, b), greatest(a, b) from e)""",
        m="""select cast(year(l_shipdate) * 12 + month(l_shipdate) as int) month_no, c_nationkey src, s_nationkey dst, count(*) n_lines
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
 join supplier on s_suppkey = l_suppkey group by 1, 2, 3""",
        e="""select (month_no - 1) // 3 * 100 + src a, (month_no - 1) // 3 * 100 + dst b from m where src <> dst
 group by (month_no - 1) // 3, src, dst""",
    ),
)
def _(core):
    return network.grouping_audit(heavy_conflicts(core), grouped(core))


@query("L11_groups")
def _(core):
    """The group of each node."""
    return grouped(core)


def grouped(core):
    """Conflict-free groups, staged once per application and data folder."""
    build = lambda path: network.conflict_free_groups(heavy_conflicts(core)).write.parquet(path)
    return core.spark.read.parquet(staged_once(core.spark, f"{zlib.crc32(core.folder.encode()):08x}-groups", build))


SESSIONS_SQL = """select c_nationkey as "class", n_regionkey teacher, l_suppkey room, cast(l_shipdate as date) - date '1995-01-01' as period
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
 join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey"""


@query(
    "L12_timetable_audit",
    sql(
        "",
        """select 'requirement_met' as "check", count(*) violations from wanted join held using ("class", teacher, room) where times <> held
 union all select 'class_clash', count(*) from (select 1 from sessions group by "class", period having count(*) > 1)
 union all select 'teacher_clash', count(*) from (select 1 from sessions group by teacher, period having count(*) > 1)
 union all select 'room_clash', count(*) from (select 1 from sessions group by room, period having count(*) > 1)
 union all select 'period_range', count(*) from sessions where period < 0 or period >= 2000""",
        sessions=SESSIONS_SQL,
        wanted="""select "class", teacher, room, count(distinct period) times from sessions group by 1, 2, 3""",
        held="""select "class", teacher, room, count(*) held from sessions group by 1, 2, 3""",
    ),
)
def _(core):
    """Shipped lines read as sessions: customer nation, supplying region and supplier per ship day."""
    sessions = (
        core.raw("lineitem")
        .join(core.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(core.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(core.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(core.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .select(
            F.col("c_nationkey").alias("class"),
            F.col("n_regionkey").alias("teacher"),
            F.col("l_suppkey").alias("room"),
            F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("period"),
        )
    )
    wanted = sessions.groupBy("class", "teacher", "room").agg(F.count_distinct("period").alias("times"))
    return network.timetable_audit(wanted, sessions, 2000)


def office_visits(core):
    """A supplier visits its nation's office, the offices of a region share rooms."""
    return core.raw("supplier").join(core.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("class"),
        F.col("n_regionkey").alias("subject"),
        F.col("s_nationkey").alias("teacher"),
        (F.col("n_regionkey") * 10 + F.col("s_suppkey") % 10).alias("room"),
        (1 + F.col("s_suppkey") % 2).alias("times"),
    )


@query("L12_placed_sessions")
def _(core):
    """The sessions and their periods."""
    return network.place_sessions(office_visits(core)).select("class", "subject", "teacher", "room", "nth", "period")


@query(
    "L12_place_sessions",
    """select unnest(['requirement_met', 'class_clash', 'teacher_clash', 'room_clash', 'period_range']) as "check",
 cast(0 as bigint) violations from (select count(*) n from supplier) where n > 0""",
)
def _(core):
    """Property check: placed sessions break no rule."""
    wanted = office_visits(core)
    placed = cut_lineage(network.place_sessions(wanted))
    # no resource can do with fewer periods than it has sessions; a session meets at most this many others
    busiest = wanted.groupBy("teacher").agg(F.sum("times").alias("n")).agg(F.max("n")).first()[0] or 0
    by_room = wanted.groupBy("room").agg(F.sum("times").alias("n")).agg(F.max("n")).first()[0] or 0
    return network.timetable_audit(wanted, placed, busiest + by_room + 2)


# --- L13, L14 ----------------------------------------------------------------------------------


def allocation_inputs(core):
    """Customers' ordered units, supplier nations as warehouses, mean line price as unit cost; the lines are joined once."""
    cells = cut_lineage(
        core.raw("lineitem")
        .join(core.raw("orders").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(core.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy(F.col("o_custkey").alias("customer_id"), F.col("s_nationkey").alias("warehouse_id"))
        .agg(F.sum("l_quantity").cast("long").alias("units"), F.sum("l_extendedprice").alias("price"))
    )
    demands = cells.groupBy("customer_id").agg(F.sum("units").alias("demand"))
    warehouses = cells.groupBy("warehouse_id").agg(
        F.floor(F.sum("units") * 1.25).cast("long").alias("capacity"), F.lit(7500.0).alias("opening_cost")
    )
    costs = cells.select("customer_id", "warehouse_id", (F.col("price") / F.col("units")).alias("unit_cost"))
    return demands, warehouses, costs


def opening(core) -> tuple[tuple, dict]:
    """The inputs and the staged plan with opened depots, made once per application and data folder."""
    inputs = tuple(cut_lineage(x) for x in allocation_inputs(core))

    def build(path: str) -> None:
        plan = facilities.open_and_allocate(*inputs)
        plan.depots.write.parquet(f"{path}/depots")
        plan.shipped.write.parquet(f"{path}/shipped")
        sums = {"sending_cost": plan.sending, "opening_cost": plan.opening, "unserved_cost": plan.unserved, "total_cost": plan.cost, "lower_bound": plan.bound}
        core.spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in sums.items())).write.parquet(f"{path}/sums")

    path = staged_once(core.spark, f"{zlib.crc32(core.folder.encode()):08x}-opening", build)
    return inputs, {name: core.spark.read.parquet(f"{path}/{name}") for name in ("depots", "shipped", "sums")}


@query("L13_opened_depots")
def _(core):
    """The depots that open, and what is used of them."""
    (_, warehouses, _), plan = opening(core)
    return plan["depots"].join(warehouses, "warehouse_id").select("warehouse_id", "capacity", "used", "opening_cost")


@query("L13_planned_shipments")
def _(core):
    """What each customer gets from each depot."""
    return opening(core)[1]["shipped"].select("customer_id", "warehouse_id", "amount")


@query("L13_opening_bound")
def _(core):
    """Cost by part, the lower bound on the cost of any plan, and the gap."""
    gap = F.try_divide(F.col("total_cost") - F.col("lower_bound"), F.col("total_cost"))
    return opening(core)[1]["sums"].withColumn("gap", gap)


@query(
    "L13_opening_rules",
    sql(
        "",
        """select count(distinct o_custkey) customers, cast(sum(l_quantity) as bigint) demand, cast(0 as bigint) over_served, cast(0 as bigint) over_capacity,
 cast(0 as bigint) not_linked, cast(0 as bigint) bound_above_cost from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey""",
    ),
)
def _(core):
    """Property check: all demand is met within capacity over given links, at no less than the bound."""
    (demands, warehouses, costs), plan = opening(core)
    got = plan["shipped"].groupBy("customer_id").agg(F.sum("amount").alias("got"))
    met = demands.join(got, "customer_id", "left").agg(
        F.count("*").alias("customers"), F.sum("got").alias("demand"), F.count_if(F.col("got") > F.col("demand")).alias("over_served")
    )
    over = plan["depots"].join(warehouses, "warehouse_id", "left").agg(F.count_if(F.col("used") > F.coalesce("capacity", F.lit(0))))
    unlinked = plan["shipped"].join(costs, ["customer_id", "warehouse_id"], "left_anti").agg(F.count("*"))
    wrong = plan["sums"].agg(F.count_if(F.col("lower_bound") > F.col("total_cost") + 1e-3))
    return met.withColumns({"over_capacity": over.scalar(), "not_linked": unlinked.scalar(), "bound_above_cost": wrong.scalar()})


@query(
    "L13_allocation_rules",
    sql(
        "",
        """select cast(sum(l_quantity) as bigint) demand, cast(0 as bigint) over_served, cast(0 as bigint) over_capacity,
 cast(0 as bigint) unserved_with_room, true within_demand, true costs_positive from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey""",
    ),
)
def _(core):
    demands, warehouses, costs = allocation_inputs(core)
    shipped = cut_lineage(network.allocate_demand(demands, warehouses, costs))
    got = shipped.groupBy("customer_id").agg(F.sum("amount").alias("got"))
    used = shipped.groupBy("warehouse_id").agg(F.sum("amount").alias("used"))
    short = demands.join(got, "customer_id", "left").filter(F.col("demand") > F.coalesce("got", F.lit(0)))
    room = warehouses.join(used, "warehouse_id", "left").filter(F.col("capacity") > F.coalesce("used", F.lit(0)))
    # a customer may go short only if every warehouse it is linked to is full
    unserved = (
        costs.join(short.select("customer_id"), "customer_id", "left_semi")
        .join(room.select("warehouse_id"), "warehouse_id", "left_semi")
        .agg(F.count("*"))
        .scalar()
    )
    return network.allocation_summary(shipped, demands, warehouses, costs).withColumn(
        "unserved_with_room", unserved
    ).select(
        "demand",
        "over_served",
        "over_capacity",
        "unserved_with_room",
        ((F.col("shipped") <= F.col("demand")) & (F.col("shipped") > 0)).alias("within_demand"),
        ((F.col("sending_cost") > 0) & (F.col("opening_cost") > 0)).alias("costs_positive"),
    )


@query(
    "L13_allocation_summary",
    sql(
        "",
        """with cells as (select o_custkey c, s_nationkey w, cast(sum(l_quantity) as bigint) units, sum(l_extendedprice) price
 from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2),
 caps as (select w, cast(floor(sum(units) * 1.25) as bigint) capacity from cells group by 1),
 one as (select c, w, units, price / units unit_cost from cells qualify row_number() over (partition by c order by price / units, w) = 1)
 select (select cast(sum(units) as bigint) from cells) demand, cast(sum(units) as bigint) shipped, cast(0 as bigint) over_served,
 (select count(*) from (select w, sum(units) u from one group by 1) join caps using (w) where u > capacity) over_capacity,
 round(sum(units * unit_cost), 2) sending_cost, cast(7500 * count(distinct w) as double) opening_cost from one""",
    ),
)
def _(core):
    """Summary of a simple allocation: each customer's own flow from its cheapest warehouse."""
    demands, warehouses, costs = allocation_inputs(core)
    flow = (
        core.raw("lineitem")
        .join(core.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(core.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .groupBy(F.col("o_custkey").alias("customer_id"), F.col("s_nationkey").alias("warehouse_id"))
        .agg(F.sum("l_quantity").cast("long").alias("amount"))
    )
    best = costs.groupBy("customer_id").agg(F.min(F.struct("unit_cost", "warehouse_id")).alias("b")).select(
        "customer_id", F.col("b.warehouse_id").alias("warehouse_id")
    )
    shipped = flow.join(best, ["customer_id", "warehouse_id"])
    summary = network.allocation_summary(shipped, demands, warehouses, costs)
    return summary.withColumn("sending_cost", F.round("sending_cost", 2))


def shipment_tables(core):
    lines = core._lines()
    shipments = lines.groupBy(
        F.col("p_id").alias("product"), F.col("w_id").alias("warehouse"), F.col("s_id").alias("store"), F.col("l_suppkey").alias("vehicle")
    ).agg(F.sum("l_quantity").cast("long").alias("boxes"))
    # some pairs want less than was shipped, so the audit has something to find
    wanted = F.when((F.col("l_linenumber") < 7) | (F.col("p_id") < 20), F.col("l_quantity")).otherwise(0)
    demands = lines.groupBy(F.col("p_id").alias("product"), F.col("s_id").alias("store")).agg(
        F.sum(wanted).cast("long").alias("demand")
    )
    stocks = lines.groupBy(F.col("p_id").alias("product"), F.col("w_id").alias("warehouse")).agg(
        (F.sum("l_quantity") * 2 - F.count("*") * 26).cast("long").alias("stock")
    )
    vans = core.raw("supplier").select(
        F.col("s_suppkey").alias("vehicle"), (F.floor(F.col("s_acctbal")) + 9000).cast("long").alias("capacity")
    )
    crew = core.raw("customer").join(
        core.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("n").cast("long").alias("vehicle"), F.col("c_custkey").alias("employee"))
    conflicts = core.raw("customer").select(F.col("c_custkey").alias("e1"), (F.col("c_custkey") + 1).alias("e2"))
    return shipments, demands, stocks, vans, crew, conflicts


SHIP = {
    "ships": """select p_id product, w_id warehouse, s_id store, l_suppkey vehicle, cast(sum(l_quantity) as bigint) boxes
 from lines group by 1, 2, 3, 4""",
    "dem": """select p_id product, s_id store, cast(sum(case when l_linenumber < 7 or p_id < 20 then l_quantity else 0 end) as bigint) demand
 from lines group by 1, 2""",
    "stk": """select p_id product, w_id warehouse, cast(sum(l_quantity) * 2 - count(*) * 26 as bigint) stock from lines group by 1, 2""",
    "vans": "select s_suppkey vehicle, cast(floor(s_acctbal) + 9000 as bigint) capacity from supplier",
    "crew": """select n vehicle, c_custkey employee from customer join (select o_custkey, count(*) n from orders group by 1)
 on o_custkey = c_custkey""",
    "trips": "select vehicle, warehouse, store, sum(boxes) ld from ships group by 1, 2, 3",
    "fleet": """select vehicle, coalesce(t, 0) t, coalesce(s, 0) s from vans left join (select vehicle, count(*) t from trips group by 1)
 using (vehicle) left join (select vehicle, count(*) s from crew group by 1) using (vehicle)""",
}


@query(
    "L14_shipment_audit",
    sql(
        "lines",
        """select 'demand_met' as "check", count(*) violations from dem full join (select product, store, sum(boxes) got from ships
 group by 1, 2) using (product, store) where coalesce(demand, 0) <> coalesce(got, 0)
 union all select 'stock_limit', count(*) from (select product, warehouse, sum(boxes) taken from ships group by 1, 2)
 left join stk using (product, warehouse) where taken > coalesce(stock, 0)
 union all select 'trip_load', count(*) from trips join vans using (vehicle) where ld > capacity
 union all select 'trip_limit', count(*) from fleet where t > 5
 union all select 'crew_size', count(*) from fleet where s <> case when t > 0 then 2 else 0 end
 union all select 'employee_once', count(*) from (select employee from crew group by 1 having count(distinct vehicle) > 1)""",
        **SHIP,
    ),
)
def _(core):
    shipments, demands, stocks, vans, crew, _conflicts = shipment_tables(core)
    return network.shipment_audit(shipments, demands, stocks, vans, crew, trip_limit=5)


@query(
    "L14_conflicted_vans",
    sql(
        "lines",
        """select a.vehicle, a.employee e1, b.employee e2 from crew a join crew b on a.vehicle = b.vehicle
 and b.employee = a.employee + 1""",
        **SHIP,
    ),
)
def _(core):
    *_rest, crew, conflicts = shipment_tables(core)
    return network.conflicted_vans(crew, conflicts)


# --- L14: the plan itself ----------------------------------------------------------------------


def shipped(core) -> tuple[tuple, dict]:
    """The inputs and the staged shipping plan, made once per application and data folder."""
    _, demands, stocks, vans, crew, conflicts = shipment_tables(core)
    employees = crew.select("employee").distinct()

    def build(path: str) -> None:
        plan = shipping.shipping_plan(demands, stocks, vans, employees, conflicts, trip_limit=5)
        plan.shipments.write.parquet(f"{path}/shipments")
        plan.crew.write.parquet(f"{path}/crew")
        core.spark.range(1).select(F.lit(plan.vans).alias("vans"), F.lit(plan.least_vans).alias("least_vans")).write.parquet(f"{path}/fleet")

    path = staged_once(core.spark, f"{zlib.crc32(core.folder.encode()):08x}-shipping", build)
    return (demands, stocks, vans, conflicts), {name: core.spark.read.parquet(f"{path}/{name}") for name in ("shipments", "crew", "fleet")}


LAID = {
    **SHIP,
    "need": """select product, store, demand, coalesce(sum(demand) over (partition by product order by store
 rows between unbounded preceding and 1 preceding), 0) low from dem where demand > 0""",
    "have": """select product, warehouse, stock, coalesce(sum(stock) over (partition by product order by warehouse
 rows between unbounded preceding and 1 preceding), 0) low from stk where stock > 0""",
    "sent": """select product, warehouse, store, cast(least(need.low + demand, have.low + stock) - greatest(need.low, have.low) as bigint) boxes
 from need join have using (product) where need.low < have.low + stock and have.low < need.low + demand""",
}


@query("L14_flows", sql("lines", "select * from sent", **LAID))
def _(core):
    """What each warehouse sends to each store, stock against demand in order."""
    _, demands, stocks, *_ = shipment_tables(core)
    return shipping.flows(demands, stocks)


@query("L14_planned_shipments")
def _(core):
    """The flows in vans."""
    return shipped(core)[1]["shipments"]


@query("L14_planned_crews")
def _(core):
    """Two employees for each van in use."""
    return shipped(core)[1]["crew"]


@query("L14_planned_fleet")
def _(core):
    """Vans in use, and the least number that could carry all boxes."""
    return shipped(core)[1]["fleet"]


@query(
    "L14_plan_rules",
    sql(
        "lines",
        """select 'demand_met' as "check", count(*) violations from dem left join (select product, store, sum(boxes) got from sent group by 1, 2)
 using (product, store) where demand <> coalesce(got, 0)
 union all select unnest(['stock_limit', 'trip_load', 'trip_limit', 'crew_size', 'employee_once', 'conflicted_van']), cast(0 as bigint)""",
        **LAID,
    ),
)
def _(core):
    """The audit of the plan: only demand that stock cannot meet stays open."""
    (demands, stocks, vans, conflicts), plan = shipped(core)
    audit = network.shipment_audit(plan["shipments"], demands, stocks, vans, plan["crew"], trip_limit=5)
    quarrels = network.conflicted_vans(plan["crew"], conflicts).agg(F.count("*").alias("violations"))
    return audit.unionByName(quarrels.select(F.lit("conflicted_van").alias("check"), "violations"))
