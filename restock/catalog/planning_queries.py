"""Planning queries: L1–L7, J13."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from restock.catalog.registry import AS_OF, calendar_sql, query, r6, sql
from restock.catalog.relational_queries import N3_SQL, needs
from restock.operators import planning, priced_plan
from restock.operators.reshape import planning_calendar
from restock.plans import reports
from restock.session import cut_lineage, staged_once

CAL = {"cal": calendar_sql()}
TABLES = "products stores demandpredictions procurements stocks transportlinks workshops"
LIMITS = planning.PlanLimits()


def links(core):
    return core.transportlinks().select(
        F.col("tl_p_id").alias("p_id"),
        F.col("tl_s_id").alias("s_id"),
        F.col("tl_w_id").alias("w_id"),
        F.col("tl_package_cost").alias("package_cost"),
        F.col("tl_package_size").alias("package_size"),
    )


def plan_inputs(core) -> planning.PlanInputs:
    return planning.PlanInputs(
        cut_lineage(needs(core)),
        cut_lineage(reports.current_stocks(core.stocks(), AS_OF)),
        cut_lineage(links(core)),
        reports.capacity_by_day(core.workshops(), AS_OF),
    )


PARTS = {
    **CAL,
    "needs": N3_SQL,
    "demand": """select p_id, s_id, c_rank, cast(coalesce(max(pred_units_sold), 0) as int) demand,
 bool_or(needs_order) needs_order, max(pred_units_sold) is null no_prediction from needs group by 1, 2, 3""",
    "start": f"select sk_p_id p_id, sk_s_id s_id, sk_units from stocks where sk_date = date '{AS_OF}'",
    "best": """select tl_p_id p_id, tl_s_id s_id, tl_w_id w_id, tl_package_size package_size, tl_package_cost package_cost
 from transportlinks qualify row_number() over (partition by tl_p_id, tl_s_id order by tl_package_cost, tl_w_id) = 1""",
    # a plan without capacity rule: each day's demand from the cheapest workshop, 30 units met at most
    "orders": """select p_id, s_id, w_id, c_rank, cast(ceil(demand / package_size) as int) packages, package_size,
 cast(ceil(demand / package_size) * package_size as int) units from demand join best using (p_id, s_id)
 where needs_order and demand > 0""",
    "flows": """select d.p_id, d.s_id, d.c_rank, d.demand, coalesce(o.units, 0) orders, least(d.demand, 30) met_demand,
 greatest(0, d.demand - 30) unmet_demand from demand d left join orders o using (p_id, s_id, c_rank)""",
    "cells": """select f.*, cast(coalesce(sk_units, 0) + sum(orders - met_demand) over (partition by p_id, s_id
 order by c_rank rows between unbounded preceding and current row) as int) closing_stocks
 from flows f left join start using (p_id, s_id)""",
}


def uncapped_plan(core, inputs):
    """Orders and cells of the plan in ``PARTS``."""
    demand = planning.cell_demand(inputs.needs)
    best = planning.ranked_links(inputs.links).filter("link_rank = 1")
    packages = F.ceil(F.col("demand") / F.col("package_size")).cast("int")
    orders = (
        demand.filter("needs_order and demand > 0")
        .join(best, ["p_id", "s_id"])
        .select("p_id", "s_id", "w_id", "c_rank", packages.alias("packages"), "package_size")
        .withColumn("units", F.col("packages") * F.col("package_size"))
    )
    flows = demand.join(
        orders.select("p_id", "s_id", "c_rank", F.col("units").alias("orders")), planning.CELL, "left"
    ).select(
        *planning.CELL,
        "demand",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.least(F.col("demand"), F.lit(30)).alias("met_demand"),
        F.greatest(F.lit(0), F.col("demand") - 30).alias("unmet_demand"),
    )
    return orders, planning.inventory_balance(flows, inputs.stocks)


@query(
    "L1_plan_inputs",
    sql(TABLES, """select d.*, coalesce(sk_units, 0) stock, (select count(*) from transportlinks t where t.tl_p_id = d.p_id
 and t.tl_s_id = d.s_id) n_links, cast(coalesce((select sum(w_capacity) from transportlinks t join workshops on w_id = tl_w_id
 where t.tl_p_id = d.p_id and t.tl_s_id = d.s_id), 0) as bigint) reachable_capacity from demand d left join start using (p_id, s_id)""", **PARTS),
)
def _(core):
    inputs = plan_inputs(core)
    reach = (
        reports.links_by_day(core.transportlinks(), AS_OF)
        .join(inputs.capacity, ["w_id", "c_rank"])
        .groupBy(*planning.CELL)
        .agg(F.count("*").alias("n_links"), F.sum("capacity").alias("reachable_capacity"))
    )
    return (
        planning.cell_demand(inputs.needs)
        .join(inputs.stocks.select("p_id", "s_id", F.col("ending_inventory").alias("stock")), ["p_id", "s_id"], "left")
        .join(reach, planning.CELL, "left")
        .fillna(0, ["stock", "n_links", "reachable_capacity"])
    )


@query(
    "L2_inventory_balance",
    sql(
        "demandfulfillments procurementplans stocks",
        f"""select df_p_id p_id, df_s_id s_id, df_date, cast(coalesce(start, 0) + sum(coalesce(u, 0) - df_met_demand) over w as bigint) closing_stocks,
 cast(coalesce(start, 0) + sum(coalesce(u, 0) - df_met_demand) over w + df_met_demand as bigint) opening_stocks from demandfulfillments
 left join (select sk_p_id, sk_s_id, sk_units start from stocks where sk_date = date '{AS_OF}') on sk_p_id = df_p_id and sk_s_id = df_s_id
 left join (select pl_p_id, pl_s_id, pl_date, sum(pl_expected_units) u from procurementplans group by 1, 2, 3)
 on pl_p_id = df_p_id and pl_s_id = df_s_id and pl_date = df_date
 window w as (partition by df_p_id, df_s_id order by df_date rows between unbounded preceding and current row)""",
    ),
)
def _(core):
    plan = reports.daily_plan(core.procurementplans()).toDF("p_id", "s_id", "df_date", "orders")
    flows = core.demandfulfillments().withColumnsRenamed({"df_p_id": "p_id", "df_s_id": "s_id"}).join(
        plan, ["p_id", "s_id", "df_date"], "left"
    ).select(
        "p_id", "s_id", "df_date", F.unix_date("df_date").alias("c_rank"),
        F.coalesce("orders", F.lit(0)).alias("orders"), F.col("df_met_demand").alias("met_demand"),
    )
    return planning.inventory_balance(flows, reports.current_stocks(core.stocks(), AS_OF)).select(
        "p_id", "s_id", "df_date", "closing_stocks", "opening_stocks"
    )


def replenishment(core) -> tuple[planning.PlanInputs, priced_plan.PricedPlan]:
    """The plan by capacity prices, staged once per application and data folder."""
    inputs = plan_inputs(core)

    def build(path: str) -> None:
        plan = priced_plan.priced_plan(inputs)
        plan.orders.write.parquet(f"{path}/orders")
        plan.cells.write.parquet(f"{path}/cells")
        core.spark.range(1).select(F.lit(plan.bound).alias("bound")).write.parquet(f"{path}/bound")

    path = staged_once(core.spark, f"{zlib.crc32(core.folder.encode()):08x}-plan", build)
    read = core.spark.read.parquet
    return inputs, priced_plan.PricedPlan(read(f"{path}/orders"), read(f"{path}/cells"), read(f"{path}/bound").first().bound)


@query("L3_replenishment_plan")
def _(core):
    """The planned orders."""
    return replenishment(core)[1].orders.select("p_id", "s_id", "w_id", "c_rank", "packages", "package_size", "units")


@query("L3_planned_cells")
def _(core):
    """Stocks, met and unmet demand of each product, store and day under the plan."""
    return replenishment(core)[1].cells


@query("L3_plan_bound")
def _(core):
    """The plan's cost by component, the lower bound on any plan's cost, and the gap between them."""
    inputs, plan = replenishment(core)
    return planning.plan_cost(plan.cells, plan.orders, inputs.links).withColumn("lower_bound", r6(F.lit(plan.bound))).withColumn(
        "gap", r6(F.try_divide(F.col("total_cost") - F.col("lower_bound"), F.col("total_cost")))
    )


@query(
    "L3_plan_days",
    sql(TABLES, "select c_rank, count(*) n_cells, cast(sum(demand) as bigint) demand from demand group by 1", **PARTS),
)
def _(core):
    """The plan's cells and the demand that they meet or leave, by day."""
    cells = replenishment(core)[1].cells
    return cells.groupBy("c_rank").agg(F.count("*").alias("n_cells"), F.sum(F.col("met_demand") + F.col("unmet_demand")).alias("demand"))


@query(
    "L3_plan_feasibility",
    sql(TABLES, """select unnest(['balance', 'demand_split', 'order_allowed', 'package_multiple', 'capacity', 'bound_above_cost']) as "constraint",
 cast(0 as bigint) violations union all select 'no_prediction', count(*) from demand where no_prediction
 union all select 'max_opening', count(*) from start join demand using (p_id, s_id) where sk_units > 120 and c_rank = 1""", **PARTS),
)
def _(core):
    """A property check: rules that any plan can meet, opening stock above the maximum only where the first day starts so,
    and a lower bound that is one."""
    inputs, plan = replenishment(core)
    rules = planning.audit_plan(plan.cells, plan.orders, inputs).filter("constraint not in ('safety_stock', 'max_opening')")
    high = plan.cells.where((F.col("opening_stocks") > LIMITS.max_opening) & ((F.col("c_rank") == 1) | (F.col("orders") > 0)))
    bound = planning.plan_cost(plan.cells, plan.orders, inputs.links).select(
        F.lit("bound_above_cost").alias("constraint"), F.when(F.col("total_cost") < plan.bound - 1e-6, 1).otherwise(0).cast("long").alias("violations")
    )
    return rules.unionByName(high.agg(F.count("*").alias("violations")).select(F.lit("max_opening").alias("constraint"), "violations")).unionByName(bound)


@query(
    "L4_plan_cost",
    sql(
        TABLES,
        """select cast(100 * sum(unmet_demand) as bigint) unmet_cost, cast(sum(greatest(0, closing_stocks + met_demand - 80)) as bigint) overstock_cost,
 cast(2 * sum(greatest(0, 40 - closing_stocks - met_demand)) as bigint) understock_cost,
 round((select sum(packages * package_cost) from orders join best using (p_id, s_id, w_id)), 6) package_cost,
 round(sum(100 * unmet_demand + greatest(0, closing_stocks + met_demand - 80) + 2 * greatest(0, 40 - closing_stocks - met_demand))
 + (select sum(packages * package_cost) from orders join best using (p_id, s_id, w_id)), 6) total_cost from cells""",
        **PARTS,
    ),
)
def _(core):
    inputs = plan_inputs(core)
    orders, cells = uncapped_plan(core, inputs)
    cost = planning.plan_cost(cells, orders, inputs.links, planning.PlanLimits(package_penalty=1))
    return cost.withColumns({c: r6(F.col(c)) for c in ("package_cost", "total_cost")})


@query(
    "L5_plan_audit",
    sql(
        TABLES,
        """select 'balance' as "constraint", cast(0 as bigint) violations
 union all select 'max_opening', count(*) from cells where closing_stocks + met_demand > 120
 union all select 'safety_stock', count(*) from cells where closing_stocks < 20
 union all select 'demand_split', count(*) from cells where met_demand + unmet_demand <> demand
 union all select 'order_allowed', count(*) from orders join demand using (p_id, s_id, c_rank) where not needs_order
 union all select 'no_prediction', count(*) from demand where no_prediction
 union all select 'package_multiple', count(*) from orders where units % package_size <> 0
 union all select 'capacity', count(*) from (select w_id, c_rank, sum(units) u from orders group by 1, 2)
 join workshops using (w_id) where u > w_capacity""",
        **PARTS,
    ),
)
def _(core):
    inputs = plan_inputs(core)
    orders, cells = uncapped_plan(core, inputs)
    return planning.audit_plan(cells, orders, inputs)


FULFIL_SQL = """select p_id df_p_id, s_id df_s_id, c_date df_date, met_demand df_met_demand, unmet_demand df_unmet_demand,
 closing_stocks df_closing_stocks, cast(met_demand + closing_stocks as int) df_initial_stocks from cells join cal using (c_rank)"""


@query("L6_fulfilment_rows", sql(TABLES, FULFIL_SQL, **PARTS))
def _(core):
    _orders, cells = uncapped_plan(core, plan_inputs(core))
    return planning.fulfilment_rows(cells, planning_calendar(core.spark, AS_OF))


@query(
    "L7_procurement_rows",
    sql(TABLES, """select p_id pl_p_id, s_id pl_s_id, w_id pl_w_id, c_date pl_date, units pl_expected_units
 from orders join cal using (c_rank) where units > 0""", **PARTS),
)
def _(core):
    orders, _cells = uncapped_plan(core, plan_inputs(core))
    return planning.procurement_rows(orders, planning_calendar(core.spark, AS_OF))


@query(
    "J13_solution_assembly",
    sql(
        "demandfulfillments sales",
        """select df_p_id p_id, df_s_id s_id, c_rank, df_met_demand met_demand, df_unmet_demand unmet_demand,
 df_closing_stocks closing_stocks, df_date c_date from demandfulfillments join (select sa_date, cast(row_number() over (
 order by sa_date) as int) c_rank from (select distinct sa_date from sales)) on sa_date = df_date""",
    ),
)
def _(core):
    """Keys with day ranks over the whole history, three value tables and the calendar."""
    from restock.operators.running import bucketed_running_total

    days = core.sales().select(F.col("sa_date").alias("c_date")).distinct().withColumns(
        {"one": F.lit(1), "all": F.lit(1), "year": F.year("c_date")}
    )
    calendar = bucketed_running_total(days, ["all"], ["year"], ["c_date"], "one", "n").select(
        "c_date", F.col("n").cast("int").alias("c_rank")
    )
    cells = core.demandfulfillments().join(calendar, F.col("df_date") == F.col("c_date")).select(
        F.col("df_p_id").alias("p_id"), F.col("df_s_id").alias("s_id"), "c_rank",
        F.col("df_met_demand").alias("met_demand"), F.col("df_unmet_demand").alias("unmet_demand"),
        F.col("df_closing_stocks").alias("closing_stocks"),
    )
    part = lambda name: cells.select(*planning.CELL, name)
    return planning.solution_table(part("met_demand"), part("unmet_demand"), part("closing_stocks"), calendar)
