"""Shipping plans pass the audit and leave open only what stock cannot meet."""

import random
from collections import defaultdict

import pytest

from restock.operators import network
from restock.operators.shipping import crews, flows, shipping_plan


def tables(spark, seed, products=20, stores=4, depots=3, vans=12, people=40):
    rng = random.Random(seed)
    demand = [(p, s, rng.randint(0, 30)) for p in range(products) for s in range(stores)]
    stock = [(p, w, rng.randint(0, 60)) for p in range(products) for w in range(depots)]
    fleet = [(v, rng.randint(40, 90)) for v in range(vans)]
    conflicts = [(e, e + 1) for e in range(people - 1)] + [(e + 5, e) for e in range(people - 5)]
    return (
        spark.createDataFrame(demand, "product int, store int, demand int"),
        spark.createDataFrame(stock, "product int, warehouse int, stock int"),
        spark.createDataFrame(fleet, "vehicle int, capacity int"),
        spark.createDataFrame([(e,) for e in range(people)], "employee int"),
        spark.createDataFrame(conflicts, "e1 int, e2 int"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_breaks_no_rule(spark, seed):
    demands, stocks, vans, people, conflicts = tables(spark, seed)
    plan = shipping_plan(demands, stocks, vans, people, conflicts, trip_limit=5)
    audit = network.shipment_audit(plan.shipments, demands, stocks, vans, plan.crew, trip_limit=5)
    broken = {r.check: r.violations for r in audit.collect()}
    wanted, held, got = defaultdict(int), defaultdict(int), defaultdict(int)
    for table, key, into in ((demands, "demand", wanted), (stocks, "stock", held), (plan.shipments, "boxes", got)):
        for r in table.collect():
            into[r["product"]] += r[key]
    assert all(got[p] == min(wanted[p], held[p]) for p in wanted)
    assert {k: v for k, v in broken.items() if k != "demand_met"} == dict.fromkeys(set(broken) - {"demand_met"}, 0)
    assert network.conflicted_vans(plan.crew, conflicts).count() == 0
    assert plan.least_vans <= plan.vans <= 2 * plan.least_vans + 2


def test_flows_follow_the_order(spark):
    demands = spark.createDataFrame([(1, 1, 5), (1, 2, 0), (1, 3, 7), (2, 1, 4)], "product int, store int, demand long")
    stocks = spark.createDataFrame([(1, 10, 3), (1, 20, 6), (3, 10, 9)], "product int, warehouse int, stock long")
    got = sorted((r["product"], r.warehouse, r.store, r.boxes) for r in flows(demands, stocks).collect())
    assert got == [(1, 10, 1, 3), (1, 20, 1, 2), (1, 20, 3, 4)]


def test_too_few_people_or_vans(spark):
    demands, stocks, vans, people, conflicts = tables(spark, 3)
    with pytest.raises(ValueError):
        shipping_plan(demands, stocks, vans.limit(1), people, conflicts, trip_limit=1)
    everyone = people.crossJoin(people.withColumnRenamed("employee", "e2")).withColumnRenamed("employee", "e1")
    with pytest.raises(ValueError):
        crews(vans, people, everyone)


def test_nothing_to_ship(spark):
    demands, stocks, vans, people, conflicts = tables(spark, 4)
    plan = shipping_plan(demands.limit(0), stocks, vans, people, conflicts, trip_limit=2)
    assert plan.vans == 0 and plan.shipments.count() == 0 and plan.crew.count() == 0
