"""Replenishment with capacity prices: a plan of low cost and a proven bound on how low it could be.

Each (workshop, day) has a price for a unit of its capacity. Under given prices every (product, store) series
solves its own package problem exactly (:mod:`restock.operators.series_plan`), and the sum of these optima less
the price of all capacity is a lower bound on the cost of any plan (Lagrange duality). Prices follow over-use from
round to round; the best bound is kept. The plan comes from the best prices: series ask for their packages, each
(workshop, day) grants what fits in order of the cost that a unit saves, and who was refused asks again
under what is left, with prices first and without them in the end, until nobody asks for more.

Every round is a few staged jobs over all series, whatever the number of days. Prices, use and grants are tables;
the driver sees three sums a round. A series' row holds its links, at most one for each workshop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restock.operators.planning import CELL, PAIR, SALTS, PlanInputs, PlanLimits, cell_demand
from restock.operators.running import bucketed_running_total, salt
from restock.operators.series_plan import SeriesBatch, Weights, solve
from restock.session import cut_lineage, drop_staged

#: first prices: a level, falling from day to day by a factor
STARTS = ((0.0, 1.0), (10.0, 0.65), (30.0, 0.65), (30.0, 1.0), (70.0, 0.65), (100.0, 1.0))
PRICED_GRANTS = 3
BATCH = 256

_SOLVED = (
    "p_id int, s_id int, candidate int, value double, own_cost double, saving double, "
    "asked array<struct<w_id: int, c_rank: int, packages: int, package_size: int>>, "
    "cells array<struct<c_rank: int, demand: int, orders: int, opening_stocks: int, met_demand: int>>"
)


@dataclass(frozen=True)
class PricedPlan:
    """orders (p, s, w, day, packages, units), cells (p, s, day, stocks and demand), a lower bound on the cost."""

    orders: DataFrame
    cells: DataFrame
    bound: float


def series_rows(inputs: PlanInputs, window: int) -> DataFrame:
    """One row per pair: stock, demand and allowed by day."""
    day = lambda d, c: F.max(F.when(F.col("c_rank") == d, F.col(c)))
    days = range(1, window + 1)
    stock = inputs.stocks.select(*PAIR, F.col("ending_inventory").cast("int").alias("stock"))
    return (
        cell_demand(inputs.needs)
        .groupBy(*PAIR)
        .agg(
            F.array(*[F.coalesce(day(d, "demand"), F.lit(0)) for d in days]).alias("demand"),
            F.array(*[F.coalesce(day(d, "needs_order"), F.lit(False)) for d in days]).alias("allowed"),
        )
        .join(stock, PAIR, "left")
        .fillna(0, ["stock"])
    )


def _spread(window: int) -> Column:
    """Prices that differ a little by series, workshop and day, so that equal offers are not all taken by all."""
    return F.expr(
        f"transform(sequence(1, {window}), t -> "
        "(1 + 0.1 * (pmod(xxhash64(p_id, s_id, w_id, t), 1000) / 1000D - 0.5)) * price[t - 1]"
        " + pmod(xxhash64(t, w_id, s_id, p_id), 1000) / 50000D)"
    )


def _batch(rows: pd.DataFrame, window: int) -> SeriesBatch:
    n = len(rows)
    links = [x if x is not None else [] for x in rows["offers"]]
    k = max([1, *map(len, links)])
    size, cost = np.zeros((n, k), np.int64), np.zeros((n, k))
    price, limit = np.zeros((n, k, window)), np.zeros((n, k, window), np.int64)
    for i, offers in enumerate(links):
        for j, o in enumerate(offers):
            size[i, j], cost[i, j] = o["package_size"], o["package_cost"]
            price[i, j], limit[i, j] = o["price"], o["room"]
    grid = lambda c: np.array(rows[c].tolist(), np.int64).reshape(n, window)
    return SeriesBatch(rows["stock"].to_numpy(), grid("demand"), grid("allowed") > 0, size, cost, price, limit, grid("fixed"))


def propose(series: DataFrame, links: DataFrame, offers: DataFrame, weights: Weights, window: int, spread: bool) -> DataFrame:
    """Each series' best decisions. ``offers``: w_id, candidate, price and room by day; ``series`` with ``fixed``."""
    price = _spread(window) if spread else F.col("price")
    offered = (
        links.join(offers, "w_id")
        .groupBy(*PAIR, "candidate")
        .agg(F.array_sort(F.collect_list(F.struct("w_id", "package_size", "package_cost", price.alias("price"), "room"))).alias("offers"))
    )
    every = series.join(offers.select("candidate").distinct(), how="cross") if not spread else series.withColumn("candidate", F.lit(0))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), BATCH):
                rows = frame.iloc[low : low + BATCH]
                batch = _batch(rows, window)
                plans = solve(batch, weights, with_idle=spread)
                asked, cells = [], []
                for i, offers in enumerate(rows["offers"]):
                    asked.append([
                        {"w_id": int(offers[k]["w_id"]), "c_rank": int(t) + 1, "packages": int(plans.packages[i, k, t]), "package_size": int(batch.size[i, k])}
                        for k, t in zip(*np.nonzero(plans.packages[i]))
                    ])
                    units = (plans.packages[i] * batch.size[i][:, None]).sum(0) + batch.fixed[i]
                    cells.append([
                        {"c_rank": t + 1, "demand": int(batch.demand[i, t]), "orders": int(units[t]),
                         "opening_stocks": int(plans.opening[i, t]), "met_demand": int(plans.met[i, t])}
                        for t in range(window)
                    ])
                ordered = np.maximum((plans.packages * batch.size[:, :, None]).sum((1, 2)), 1)
                yield pd.DataFrame({
                    "p_id": rows["p_id"], "s_id": rows["s_id"], "candidate": rows["candidate"], "value": plans.value, "own_cost": plans.own_cost,
                    "saving": (plans.idle_cost - plans.own_cost) / ordered, "asked": asked, "cells": cells,
                })

    # few bytes and much work: as many tasks as cores, whatever adaptive execution would merge
    tasks = series.sparkSession.sparkContext.defaultParallelism
    return every.join(offered, [*PAIR, "candidate"], "left").repartition(tasks, *PAIR, "candidate").mapInPandas(work, _SOLVED)


def _by_day(table: DataFrame, keys: list[str], value: str, window: int, name: str) -> DataFrame:
    day = lambda d: F.coalesce(F.max(F.when(F.col("c_rank") == d, F.col(value))), F.lit(0))
    return table.groupBy(*keys).agg(F.array(*[day(d) for d in range(1, window + 1)]).alias(name))


def _units(solved: DataFrame) -> DataFrame:
    return solved.select("candidate", F.inline("asked")).groupBy("candidate", "w_id", "c_rank").agg(
        F.sum(F.col("packages") * F.col("package_size")).alias("used")
    )


def capacity_prices(
    series: DataFrame, links: DataFrame, capacity: DataFrame, weights: Weights, window: int, rounds: int
) -> tuple[DataFrame, float]:
    """(w_id, c_rank, capacity, price) with the best bound found, and that bound.

    The first round compares starting prices; every further one moves prices along the over-use (smoothed
    over rounds) by a step towards a target slightly above the best bound, shorter after rounds without gain.
    """
    spark = series.sparkSession
    series = series.withColumn("fixed", F.array_repeat(F.lit(0), window))
    endless = F.array_repeat(F.lit(weights.max_opening), window).alias("room")
    starts = [(k, *start) for k, start in enumerate(STARTS)]
    table = capacity.crossJoin(spark.createDataFrame(starts, "candidate int, level double, factor double")).select(
        "candidate", "w_id", "c_rank", "capacity", (F.col("level") * F.pow("factor", F.col("c_rank") - 1)).alias("price"), F.lit(0.0).alias("drift")
    )
    table = cut_lineage(table)
    best, best_table, step, idle = -np.inf, table, 0.5, 0
    for turn in range(rounds + 1):
        offers = _by_day(table, ["w_id", "candidate"], "price", window, "price").withColumn("room", endless)
        solved = cut_lineage(propose(series, links, offers, weights, window, spread=False))
        values = solved.groupBy("candidate").agg(F.sum("value").alias("value"))
        if turn == 0:
            paid = table.groupBy("candidate").agg(F.sum(F.col("price") * F.col("capacity")).alias("paid"))
            worth = F.col("value") - F.coalesce("paid", F.lit(0.0))
            first = values.join(paid, "candidate", "left").orderBy(F.desc(worth), "candidate").select("candidate").first()
            if first is None:
                return table, 0.0
            table = table.where(F.col("candidate") == first.candidate)
        over = F.coalesce("used", F.lit(0)) - F.col("capacity")
        smooth = over if turn == 0 else 0.7 * over + 0.3 * F.col("drift")
        moved = cut_lineage(
            table.join(_units(solved), ["candidate", "w_id", "c_rank"], "left")
            .select("candidate", "w_id", "c_rank", "capacity", "price", smooth.cast("double").alias("drift"))
        )
        held = (F.col("price") <= 0) & (F.col("drift") < 0)  # unused capacity without a price keeps none
        at = moved.groupBy("candidate").agg(
            F.sum(F.col("price") * F.col("capacity")).alias("paid"),
            F.sum(F.when(held, 0.0).otherwise(F.col("drift") * F.col("drift"))).alias("length"),
        )
        here = values.join(at, "candidate").select((F.col("value") - F.col("paid")).alias("bound"), "length").first()
        drop_staged(spark, solved)
        if here is None:  # no workshop at all
            return moved, 0.0
        if here.bound > best + 1e-9:
            best, best_table, idle = here.bound, moved, 0
        else:
            idle += 1
            if idle % 2 == 0:
                step *= 0.6
        if not here.length or turn == rounds:
            break
        ahead = step * (best + 0.12 * abs(best) - here.bound) / here.length
        table = moved.withColumn("price", F.greatest(F.lit(0.0), F.col("price") + F.lit(ahead) * F.col("drift")))
    return best_table.select("w_id", "c_rank", "capacity", "price"), float(best)


def grant(asked: DataFrame, left: DataFrame) -> DataFrame:
    """What fits of each (workshop, day)'s requests, by saving per unit; past the capacity, the packages that still fit.

    The order is total (saving in steps of 1, salt, pair), so results do not depend on partitioning, and requests to
    one workshop spread over many tasks.
    """
    requests = asked.withColumns(
        {"units": F.col("packages") * F.col("package_size"), "turn": -F.floor("saving"), "salt": salt(PAIR, SALTS)}
    )
    total = bucketed_running_total(requests, ["w_id", "c_rank"], ["turn", "salt"], PAIR, "units", "running")
    free = F.col("left") - (F.col("running") - F.col("units"))
    granted = F.greatest(F.lit(0), F.least(F.col("packages"), F.floor(free / F.col("package_size")))).cast("int")
    return (
        total.join(left, ["w_id", "c_rank"])
        .withColumn("packages", granted)
        .where("packages > 0")
        .select(*PAIR, "w_id", "c_rank", "packages", "package_size")
    )


def priced_plan(inputs: PlanInputs, window: int = 7, limits: PlanLimits = PlanLimits(), rounds: int = 8) -> PricedPlan:
    """A feasible plan and a lower bound on the cost of any (see the module); ``rounds`` of price changes."""
    weights = Weights(
        limits.max_opening, limits.overstock_level, limits.understock_level, limits.safety_stock,
        limits.unmet_penalty, limits.overstock_penalty, limits.understock_penalty, limits.package_penalty,
    )
    spark = inputs.needs.sparkSession
    series = cut_lineage(series_rows(inputs, window))
    links = cut_lineage(inputs.links.where("package_size > 0").select(*PAIR, "w_id", "package_size", "package_cost"))
    capacity = cut_lineage(inputs.capacity.select("w_id", "c_rank", F.coalesce("capacity", F.lit(0)).alias("capacity")))
    prices, bound = capacity_prices(series, links, capacity, weights, window, rounds)
    granted = cut_lineage(links.where("false").select(*PAIR, "w_id", F.lit(0).alias("c_rank"), F.lit(0).alias("packages"), "package_size"))
    turn = 0
    while True:
        sums = granted.groupBy("w_id", "c_rank").agg(F.sum(F.col("packages") * F.col("package_size")).alias("used"))
        left = prices.join(sums, ["w_id", "c_rank"], "left").select(
            "w_id", "c_rank", F.when(F.lit(turn < PRICED_GRANTS), F.col("price")).otherwise(0.0).alias("price"),
            (F.col("capacity") - F.coalesce("used", F.lit(0))).cast("int").alias("left"),
        )
        got = granted.groupBy(*CELL).agg(F.sum(F.col("packages") * F.col("package_size")).cast("int").alias("units"))
        fixed = _by_day(got, PAIR, "units", window, "fixed")
        ready = series.join(fixed, PAIR, "left").withColumn("fixed", F.coalesce("fixed", F.array_repeat(F.lit(0), window)))
        offers = _by_day(left, ["w_id"], "price", window, "price").join(_by_day(left, ["w_id"], "left", window, "room"), "w_id")
        solved = cut_lineage(propose(ready, links, offers.withColumn("candidate", F.lit(0)), weights, window, spread=True))
        asked = solved.select(*PAIR, "saving", F.inline("asked"))
        if asked.isEmpty():
            if turn >= PRICED_GRANTS:
                break
            turn = PRICED_GRANTS
            continue
        more = cut_lineage(granted.unionByName(grant(asked, left.select("w_id", "c_rank", "left"))))
        drop_staged(spark, granted)
        granted = more
        drop_staged(spark, solved)
        turn += 1
    merged = granted.groupBy(*PAIR, "w_id", "c_rank", "package_size").agg(F.sum("packages").cast("int").alias("packages"))
    orders = merged.withColumn("units", F.col("packages") * F.col("package_size"))
    cells = solved.select(*PAIR, F.inline("cells")).withColumns(
        {
            "unmet_demand": F.col("demand") - F.col("met_demand"),
            "closing_stocks": F.col("opening_stocks") - F.col("met_demand"),
        }
    )
    return PricedPlan(orders, cells, bound)
