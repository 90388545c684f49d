"""Replenishment planning: inputs, plan, costs and audits over (product, store, day) tables.

Columns: ``p_id, s_id, w_id`` ids, ``c_rank`` the planning day (1 … window).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restock.functions.numeric import excess_over, shortfall_under
from restock.operators.running import bucketed_running_total, salt
from restock.session import cut_lineage

PAIR = ["p_id", "s_id"]
CELL = ["p_id", "s_id", "c_rank"]
SALTS = 64


@dataclass(frozen=True)
class PlanLimits:
    """Stock limits and cost weights (fixed values)."""

    max_opening: int = 120
    overstock_level: int = 80
    understock_level: int = 40
    safety_stock: int = 20
    unmet_penalty: int = 100
    overstock_penalty: int = 1
    understock_penalty: int = 2
    package_penalty: int = 0


@dataclass(frozen=True)
class PlanInputs:
    """needs (p,s,t,pred_units_sold,needs_order), stocks (p,s,ending_inventory),
    links (p,s,w,package_cost,package_size), capacity (w,t,capacity)."""

    needs: DataFrame
    stocks: DataFrame
    links: DataFrame
    capacity: DataFrame


def cell_demand(needs: DataFrame) -> DataFrame:
    """One row per cell; a missing prediction counts as zero demand."""
    return needs.groupBy(*CELL).agg(
        F.coalesce(F.max("pred_units_sold"), F.lit(0)).cast("int").alias("demand"),
        F.max("needs_order").alias("needs_order"),
        F.max("pred_units_sold").isNull().alias("no_prediction"),
    )


def ranked_links(links: DataFrame) -> DataFrame:
    """Links of a product and store from the cheapest on; a pair has one link per workshop."""
    order = Window.partitionBy(*PAIR).orderBy("package_cost", "w_id")
    return links.withColumn("link_rank", F.row_number().over(order))


# --- balance -----------------------------------------------------------------------------------


def inventory_balance(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Opening and closing stock per cell from the starting stock (missing = 0), ``orders`` and
    ``met_demand``: closing = start + all orders so far - all met demand so far."""
    past = Window.partitionBy(*PAIR).orderBy("c_rank").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce("ending_inventory", F.lit(0))
    closing = start + F.sum(F.col("orders") - F.col("met_demand")).over(past)
    return (
        flows.join(stocks.select(*PAIR, "ending_inventory"), PAIR, "left")
        .withColumn("closing_stocks", closing)
        .withColumn("opening_stocks", F.col("closing_stocks") + F.col("met_demand"))
        .drop("ending_inventory")
    )


# --- plan --------------------------------------------------------------------------------------


def _wanted(limits: PlanLimits) -> tuple[Column, Column]:
    """(units still needed to reach the target level, units that fit below the maximum)."""
    target = F.least(
        F.lit(limits.max_opening),
        F.greatest(F.lit(limits.understock_level), F.col("demand") + limits.safety_stock),
    )
    allowed = F.col("needs_order")
    need = F.when(allowed, F.greatest(F.lit(0), target - F.col("stock"))).otherwise(0)
    room = F.when(allowed, F.greatest(F.lit(0), limits.max_opening - F.col("stock"))).otherwise(0)
    return need.cast("int"), room.cast("int")


def _asked(today: DataFrame, granted: DataFrame, links: DataFrame) -> DataFrame:
    """Packages each pair still asks for over one link, after what it was granted so far."""
    got = granted.groupBy(*PAIR).agg(F.sum("units").cast("int").alias("got"))
    rest = today.join(got, PAIR, "left").fillna(0, ["got"])
    need, room = F.col("need") - F.col("got"), F.col("room") - F.col("got")
    size = F.col("package_size")
    packages = F.least(F.ceil(need / size), F.floor(room / size)).cast("int")
    return (
        rest.filter(need > 0)
        .join(links, PAIR)
        .select(*PAIR, "w_id", need.alias("need"), packages.alias("packages"), "package_size")
        .filter("packages > 0")
    )


def _served(today: DataFrame, granted: DataFrame) -> bool:
    """Whether every pair has got what it needs."""
    got = granted.groupBy(*PAIR).agg(F.sum("units").alias("got"))
    open_need = today.join(got, PAIR, "left").filter(F.col("need") > F.coalesce("got", F.lit(0)))
    return open_need.isEmpty()


def _grant(asked: DataFrame, left: DataFrame) -> DataFrame:
    """Share each workshop's remaining capacity in order of need.

    ``asked``: p, s, w, need, packages, package_size. A request past the capacity gets the whole
    packages that still fit. The order is total (need, salt, product, store), so the result does
    not depend on the partitioning, and one workshop's requests spread over many tasks.
    """
    requests = asked.withColumn("units", F.col("packages") * F.col("package_size")).withColumns(
        {"neg_need": -F.col("need"), "salt": salt(PAIR, SALTS)}
    )
    total = bucketed_running_total(
        requests, ["w_id"], ["neg_need", "salt"], PAIR, "units", "running"
    ).join(left, "w_id")
    free = F.col("capacity_left") - (F.col("running") - F.col("units"))
    fits = F.floor(free / F.col("package_size")).cast("int")
    granted = F.greatest(F.lit(0), F.least(F.col("packages"), fits))
    return (
        total.withColumn("packages", granted.cast("int"))
        .filter("packages > 0")
        .select(*PAIR, "w_id", "packages", "package_size")
        .withColumn("units", F.col("packages") * F.col("package_size"))
    )


def replenishment_plan(
    inputs: PlanInputs, window: int = 7, limits: PlanLimits = PlanLimits()
) -> tuple[DataFrame, DataFrame]:
    """(orders, cells): a feasible plan with respect to packages, capacity, maximum and balance.

    Day by day, every pair asks for whole packages up to its target level, first from its cheapest
    workshop and then from the next ones; a workshop serves the largest needs first. The plan is
    not optimal. A cell whose stock stays below the safety level shows up in :func:`audit_plan`.

    The day loop has ``window`` steps. The link loop has one step per link of a pair (at most the
    number of workshops) and ends as soon as nobody needs more; a step is one staged job over all pairs.
    """
    demand = cut_lineage(cell_demand(inputs.needs))
    links = cut_lineage(ranked_links(inputs.links))
    capacity = cut_lineage(inputs.capacity)
    n_ranks = links.agg(F.max("link_rank")).first()[0] or 0
    stock = demand.select(*PAIR).distinct().join(
        inputs.stocks.select(*PAIR, F.col("ending_inventory").cast("int").alias("stock")), PAIR, "left"
    ).fillna(0, ["stock"])
    nothing = links.filter("false").select(
        *PAIR, "w_id", F.lit(0).alias("packages"), "package_size", F.lit(0).alias("units")
    )
    orders, cells = [], []
    for day in range(1, window + 1):
        need, room = _wanted(limits)
        today = cut_lineage(
            demand.filter(F.col("c_rank") == day)
            .join(stock, PAIR)
            .select(*PAIR, "demand", "stock", need.alias("need"), room.alias("room"))
        )
        granted = nothing
        for rank in range(1, n_ranks + 1):
            asked = _asked(today, granted, links.filter(F.col("link_rank") == rank))
            used = granted.groupBy("w_id").agg(F.sum("units").alias("used"))
            left = (
                capacity.filter(F.col("c_rank") == day)
                .join(used, "w_id", "left")
                .select("w_id", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("capacity_left"))
            )
            share = cut_lineage(_grant(asked, left))
            if not share.isEmpty():
                granted = share if granted is nothing else granted.unionByName(share)
            if rank < n_ranks and _served(today, granted):
                break
        orders.append(granted.withColumn("c_rank", F.lit(day)))
        delivered = granted.groupBy(*PAIR).agg(F.sum("units").cast("int").alias("orders"))
        flow = today.join(delivered, PAIR, "left").fillna(0, ["orders"])
        opening = F.col("stock") + F.col("orders")
        met = F.least(F.col("demand"), F.greatest(F.lit(0), opening - limits.safety_stock))
        done = cut_lineage(
            flow.select(
                *PAIR,
                F.lit(day).alias("c_rank"),
                "demand",
                "orders",
                opening.alias("opening_stocks"),
                met.alias("met_demand"),
                (F.col("demand") - met).alias("unmet_demand"),
                (opening - met).alias("closing_stocks"),
            )
        )
        cells.append(done)
        stock = done.select(*PAIR, F.col("closing_stocks").alias("stock"))
    return reduce(DataFrame.unionByName, orders), reduce(DataFrame.unionByName, cells)


# --- cost and audit ----------------------------------------------------------------------------


def plan_cost(
    cells: DataFrame, orders: DataFrame, links: DataFrame, limits: PlanLimits = PlanLimits()
) -> DataFrame:
    """Cost by component: unmet demand, over- and understock of the opening level, packages."""
    opening = F.col("opening_stocks")
    stock_cost = cells.agg(
        (limits.unmet_penalty * F.sum("unmet_demand")).cast("long").alias("unmet_cost"),
        (limits.overstock_penalty * F.sum(excess_over(opening, limits.overstock_level)))
        .cast("long")
        .alias("overstock_cost"),
        (limits.understock_penalty * F.sum(shortfall_under(opening, limits.understock_level)))
        .cast("long")
        .alias("understock_cost"),
    )
    price = links.select(*PAIR, "w_id", "package_cost")
    package_cost = (
        orders.join(price, [*PAIR, "w_id"])
        .agg(F.coalesce(F.sum(F.col("packages") * F.col("package_cost")), F.lit(0.0)).alias("c"))
        .scalar()
    )
    return stock_cost.withColumn("package_cost", package_cost * limits.package_penalty).withColumn(
        "total_cost",
        F.col("unmet_cost") + F.col("overstock_cost") + F.col("understock_cost") + F.col("package_cost"),
    )


def audit_plan(
    cells: DataFrame, orders: DataFrame, inputs: PlanInputs, limits: PlanLimits = PlanLimits()
) -> DataFrame:
    """(constraint, violations) for every rule of the plan; each rule is one aggregate."""

    def count(name: str, df: DataFrame, rule: Column) -> DataFrame:
        return df.agg(F.count_if(rule).alias("violations")).select(
            F.lit(name).alias("constraint"), "violations"
        )

    sizes = inputs.links.select(*PAIR, "w_id", "package_size")
    sized = orders.select(*PAIR, "w_id", "c_rank", "units").join(sizes, [*PAIR, "w_id"], "left")
    load = orders.groupBy("w_id", "c_rank").agg(F.sum("units").alias("load")).join(
        inputs.capacity, ["w_id", "c_rank"], "left"
    )
    ordered = orders.groupBy(*CELL).agg(F.sum("units").alias("ordered"))
    demand = cell_demand(inputs.needs)
    before = F.lag("closing_stocks").over(Window.partitionBy(*PAIR).orderBy("c_rank"))
    full = (
        cells.join(demand.select(*CELL, F.col("demand").alias("wanted"), "needs_order", "no_prediction"), CELL, "left")
        .join(ordered, CELL, "left")
        .join(inputs.stocks.select(*PAIR, "ending_inventory"), PAIR, "left")
        .fillna(0, ["ordered", "ending_inventory"])
        .withColumn("before", F.coalesce(before, F.col("ending_inventory")))
        .withColumn("level", F.col("before") + F.col("ordered"))
    )
    met, unmet, closing = F.col("met_demand"), F.col("unmet_demand"), F.col("closing_stocks")
    rules = {
        "balance": closing != F.col("level") - met,
        "max_opening": F.col("level") > limits.max_opening,
        "safety_stock": closing < limits.safety_stock,
        "demand_split": met + unmet != F.col("wanted"),
        "order_allowed": (F.col("ordered") > 0) & ~F.col("needs_order"),
        "no_prediction": F.col("no_prediction"),
    }
    counted = full.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    by_cell = counted.unpivot([], list(rules), "constraint", "violations")
    return (
        by_cell.unionByName(
            count(
                "package_multiple",
                sized,
                F.col("package_size").isNull() | (F.col("units") % F.col("package_size") != 0),
            )
        ).unionByName(count("capacity", load, F.col("load") > F.coalesce("capacity", F.lit(0))))
    )


def idle_capacity(
    cells: DataFrame, orders: DataFrame, inputs: PlanInputs, limits: PlanLimits = PlanLimits()
) -> DataFrame:
    """(constraint, violations): links over which a pair could still get a package that it needs.

    A workshop counts as idle if it has room for the largest package. A plan that leaves need open while
    a linked workshop is idle, such as an empty plan, breaks this rule.
    """
    need, room = _wanted(limits)
    allowed = cell_demand(inputs.needs).select(*CELL, "needs_order")
    short = (
        cells.join(allowed, CELL)
        .withColumn("stock", F.col("opening_stocks") - F.col("orders"))
        .select(*CELL, (need - F.col("orders")).alias("need"), (room - F.col("orders")).alias("room"))
        .filter("need > 0")
    )
    load = orders.groupBy("w_id", "c_rank").agg(F.sum("units").alias("load"))
    largest = inputs.links.agg(F.max("package_size")).scalar()
    idle = (
        inputs.capacity.join(load, ["w_id", "c_rank"], "left")
        .filter(F.col("capacity") - F.coalesce("load", F.lit(0)) >= largest)
        .select("w_id", "c_rank")
    )
    return (
        short.join(inputs.links, PAIR)
        .filter(F.col("package_size") <= F.col("room"))
        .join(idle, ["w_id", "c_rank"], "left_semi")
        .agg(F.count("*").alias("violations"))
        .select(F.lit("idle_capacity").alias("constraint"), "violations")
    )


# --- result tables -----------------------------------------------------------------------------


def solution_table(met: DataFrame, unmet: DataFrame, closing: DataFrame, calendar: DataFrame) -> DataFrame:
    """Assemble (p, s, t, value) solutions and put dates in place of ranks."""
    return (
        met.join(unmet, CELL, "left").join(closing, CELL, "left").join(calendar, "c_rank", "left")
    )


def fulfilment_rows(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stored form of the plan; the initial stock counts the day's deliveries: met + closing."""
    part = lambda name: cells.select(*CELL, name)
    return solution_table(
        part("met_demand"), part("unmet_demand"), part("closing_stocks"), calendar
    ).select(
        F.col("p_id").alias("df_p_id"),
        F.col("s_id").alias("df_s_id"),
        F.col("c_date").alias("df_date"),
        F.col("met_demand").cast("int").alias("df_met_demand"),
        F.col("unmet_demand").cast("int").alias("df_unmet_demand"),
        F.col("closing_stocks").cast("int").alias("df_closing_stocks"),
        (F.col("met_demand") + F.col("closing_stocks")).cast("int").alias("df_initial_stocks"),
    )


def procurement_rows(orders: DataFrame, calendar: DataFrame) -> DataFrame:
    """Packages to expected units per product, store, workshop and day; nothing below one unit."""
    units = (F.col("packages") * F.col("package_size")).cast("int")
    return (
        orders.withColumn("pl_expected_units", units)
        .filter("pl_expected_units > 0")
        .join(calendar, "c_rank", "left")
        .select(
            F.col("p_id").alias("pl_p_id"),
            F.col("s_id").alias("pl_s_id"),
            F.col("w_id").alias("pl_w_id"),
            F.col("c_date").alias("pl_date"),
            "pl_expected_units",
        )
    )
