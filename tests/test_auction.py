"""The auction against the best of all permutations."""

import random
from itertools import permutations

import pytest

from restock.operators import auction
from restock.operators.auction import auction_assignment


def best_cost(costs, n, m, open_cost):
    """Least cost over all ways to give each of n tasks a worker of m or none."""
    slots = list(range(m)) + [None] * n
    best = float("inf")
    seen = set()
    for p in permutations(slots, n):
        if p in seen:
            continue
        seen.add(p)
        best = min(best, sum(min(costs.get((t, w), open_cost), float("inf")) if w is not None else open_cost for t, w in enumerate(p)))
    return best


@pytest.mark.parametrize("n, m, share", [(6, 6, 1.0), (4, 6, 1.0), (5, 5, 0.5)])
def test_whole_costs_give_an_optimum(spark, n, m, share):
    rng = random.Random(n * 10 + m)
    costs = {(t, w): rng.randint(1, 40) for t in range(n) for w in range(m) if rng.random() < share}
    rows = [(t, w, c) for (t, w), c in costs.items()]
    df = spark.createDataFrame(rows + rows[:2], "task int, worker int, cost long")
    result = auction_assignment(df, epsilon=0.9 / n, open_cost=50)
    tasks, workers = {t for t, _ in costs}, {w for _, w in costs}
    if len(tasks) == n and len(workers) >= n:
        assert result.cost == best_cost(costs, n, m, 50)
    got = result.assigned.collect()
    assert len({r.task for r in got}) == len({r.worker for r in got}) == len(got)
    assert all(costs[r.task, r.worker] == r.cost for r in got)
    assert result.bound <= result.cost + 1e-9 and result.cost - result.bound <= result.bidders * result.epsilon + 1e-9


def test_more_tasks_than_workers(spark):
    """Workers bid then; the gap is a share of the cost."""
    rng = random.Random(2)
    rows = [(t, w, rng.randint(100, 900)) for t in range(60) for w in range(9) if rng.random() < 0.4]
    result = auction_assignment(spark.createDataFrame(rows, "task long, worker long, cost long"), gap=0.02)
    assert result.bidders == 9 and result.assigned.count() == 9
    assert result.bound <= result.cost <= result.bound * 1.03


def test_dear_pairs_stay_open(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 3, 99)], "task int, worker int, cost int")
    result = auction_assignment(df, epsilon=0.1, open_cost=20)
    assert [tuple(r) for r in result.assigned.collect()] == [(1, 1, 5)]
    assert result.cost == 25 and result.cost - result.bound <= 0.2 + 1e-9


def test_nothing_to_assign(spark):
    result = auction_assignment(spark.createDataFrame([], "task int, worker int, cost int"))
    assert result.assigned.count() == 0 and result.cost == result.bound == 0


def test_large_tables_of_pairs_are_dealt_to_more_tasks(spark, monkeypatch):
    """As many tasks as spark.sql.shuffle.partitions says before, however many pairs there are."""
    pairs = spark.range(60).selectExpr("id % 4 bidder", "id div 4 object", "double(1 + id * 37 % 101) cost")
    costs = pairs.selectExpr("bidder task", "object worker", "cost")
    whole = auction_assignment(costs)
    monkeypatch.setattr(auction, "ROWS_IN_TASK", 25)
    dealt = auction_assignment(costs)
    assert sorted(dealt.assigned.collect()) == sorted(whole.assigned.collect()) and dealt.bound == pytest.approx(whole.bound)
    prices = pairs.selectExpr("object", "0.0D price").distinct()
    plan = auction._bids(pairs, prices, pairs.select("bidder").distinct(), 200.0, 0.1, 400)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bidder" in plan and ", 16), REPARTITION_BY_NUM" in plan
