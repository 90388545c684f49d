"""Opened depots and shipments against the best of all plans on small instances."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from restock.operators import network
from restock.operators.facilities import _close_one, _served, open_and_allocate


def best_cost(demands, depots, costs, unserved):
    """Unit by unit over all remaining capacities, for each set of open depots."""
    units = [c for c, d in demands.items() for _ in range(d)]
    names = list(depots)
    best = float("inf")
    for chosen in range(1 << len(names)):
        fee = sum(depots[w][1] for k, w in enumerate(names) if chosen >> k & 1)

        @lru_cache(None)
        def least(at, room, fee=fee):
            if at == len(units):
                return 0.0
            found = unserved + least(at + 1, room)
            for k, w in enumerate(names):
                if room[k] and (units[at], w) in costs:
                    found = min(found, costs[units[at], w] + least(at + 1, room[:k] + (room[k] - 1,) + room[k + 1 :]))
            return found

        best = min(best, fee + least(0, tuple(depots[w][0] if chosen >> k & 1 else 0 for k, w in enumerate(names))))
    return best


def frames(spark, demands, depots, costs):
    return (
        spark.createDataFrame(list(demands.items()), "customer_id int, demand int"),
        spark.createDataFrame([(w, c, f) for w, (c, f) in depots.items()], "warehouse_id int, capacity int, opening_cost double"),
        spark.createDataFrame([(c, w, x) for (c, w), x in costs.items()], "customer_id int, warehouse_id int, unit_cost double"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_cost_lies_between_bound_and_a_little_above_the_least(spark, seed):
    rng = random.Random(seed)
    demands = {c: rng.randint(1, 3) for c in range(5)}
    depots = {w: (rng.randint(3, 6), float(rng.randint(3, 12))) for w in range(3)}
    costs = {(c, w): float(rng.randint(1, 9)) for c in demands for w in depots if rng.random() < 0.9}
    plan = open_and_allocate(*frames(spark, demands, depots, costs), unserved_cost=30.0, rounds=8)
    least = best_cost(demands, depots, costs, 30.0)
    assert plan.bound <= least + 1e-6 <= plan.cost + 2e-6
    assert plan.cost <= 1.25 * least
    sent = {(r.customer_id, r.warehouse_id): r.amount for r in plan.shipped.collect()}
    assert all(key in costs and a > 0 for key, a in sent.items())
    assert all(sum(a for (c, _), a in sent.items() if c == k) <= d for k, d in demands.items())
    assert all(sum(a for (_, w), a in sent.items() if w == k) <= c for k, (c, _) in depots.items())


def test_a_dear_depot_closes_and_its_customers_move(spark):
    demands = {1: 4, 2: 4, 3: 4}
    depots = {10: (100, 5.0), 20: (100, 50.0)}
    costs = {(1, 10): 1.0, (2, 10): 2.0, (3, 10): 3.0, (3, 20): 1.0, (2, 20): 1.0}
    plan = open_and_allocate(*frames(spark, demands, depots, costs), rounds=4)
    assert [r.warehouse_id for r in plan.depots.collect()] == [10]
    assert plan.cost == 4 * 6 + 5 and plan.unserved == 0


def test_a_depot_closes_after_any_number_that_seemed_to_save_more_cannot(spark):
    """Only the three that seemed to save most were tried before."""
    names = [1, 2, 3]  # each looks at the last unit of room in depot 9 and cannot reach the room of depot 8
    demands = {**{w: 5 for w in names}, 4: 1, 9: 5, 8: 1}
    depots = {**{w: (5, 100.0) for w in names}, 4: (1, 10.0), 9: (6, 0.0), 8: (100, 0.0)}
    costs = {**{(w, w): 1.0 for w in demands}, **{(w, 9): 2.0 for w in [*names, 4]}}
    _, warehouses, links = frames(spark, demands, depots, costs)
    shipped = spark.createDataFrame([(w, w, d) for w, d in demands.items()], "customer_id int, warehouse_id int, amount long")
    after = _close_one(shipped, warehouses, links)
    assert after is not None
    assert {tuple(r) for r in after.collect()} == {(w, 9 if w == 4 else w, d) for w, d in demands.items()}
    assert _close_one(after, warehouses, links) is None


def test_cost_is_below_the_cheapest_first_allocation(spark):
    rng = random.Random(4)
    demands = {c: rng.randint(1, 40) for c in range(80)}
    depots = {w: (350, 100.0) for w in range(6)}
    costs = {(c, w): rng.uniform(1, 50) for c in demands for w in depots}
    tables = frames(spark, demands, depots, costs)
    plan = open_and_allocate(*tables, rounds=12)
    greedy = network.allocation_summary(network.allocate_demand(*tables), *tables).first()
    assert greedy.shipped == sum(demands.values()) and plan.unserved == 0
    assert plan.bound <= plan.cost < greedy.sending_cost + greedy.opening_cost


def test_nobody_to_serve_and_nobody_who_serves(spark):
    demands, depots, costs = frames(spark, {1: 2}, {1: (5, 1.0)}, {(1, 1): 1.0})
    plan = open_and_allocate(demands.limit(0), depots, costs, rounds=2)
    assert plan.shipped.count() == 0 and plan.cost == 0
    plan = open_and_allocate(demands, depots.limit(0), costs, unserved_cost=9.0, rounds=2)
    assert plan.shipped.count() == 0 and plan.cost == plan.bound == 18.0


def test_rounds_send_nothing_of_the_customers_through_the_driver(spark):
    """Customers, shipments and offsets were broadcast in every round before."""
    links = spark.range(200).selectExpr(
        "id % 50 customer_id", "id % 4 warehouse_id", "double(id % 7) unit_cost", "3L demand", "90L capacity", "double(5) opening_cost"
    )
    prices = links.groupBy("customer_id").agg(F.max("demand").alias("demand"), F.lit(9.0).alias("pay"))
    served = _served(links, prices, 20.0)
    rest = network._less(prices.select("customer_id", "demand"), "demand", links.selectExpr("customer_id", "2 amount"), "customer_id")
    for df, joins in ((served, 2), (rest, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("ShuffledHashJoin") >= joins


def test_lines_are_joined_once_for_the_allocation(spark):
    """Customers, depots and costs each read and joined the lines again before."""
    from restock.catalog.network_queries import allocation_inputs
    from restock.sources.star_schema import StarSchema

    for part in allocation_inputs(StarSchema(spark, "/root/testdata/sf0.001")):
        assert not any("lineitem" in name for name in part.inputFiles())
