"""Round-based algorithms against sequential ones on random instances."""

import random

import pytest

from restock.operators import network


def test_budget_path_is_exact(spark):
    rng = random.Random(2)
    edges = [
        (u, v, rng.randrange(1, 20), rng.randrange(0, 6))
        for u in range(12)
        for v in range(12)
        if u != v and rng.random() < 0.3
    ]
    budget = 12
    best = {(0, 0): 0}
    changed = True
    while changed:
        changed = False
        for u, v, d, c in edges:
            for spent in range(budget - c + 1):
                if (u, spent) in best and best[(u, spent)] + d < best.get((v, spent + c), 10**9):
                    best[(v, spent + c)] = best[(u, spent)] + d
                    changed = True
    df = spark.createDataFrame(edges, "src LONG, dst LONG, distance LONG, cost LONG")
    states = network.budget_path_states(df, 0, budget)
    assert {(r.node, r.spent): r.total for r in states.collect()} == best
    reachable = [(total, spent) for (node, spent), total in best.items() if node == 11]
    got = network.shortest_within_budget(states, 11).collect()
    assert [tuple(r) for r in got] == sorted(reachable)[:1]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_assignment_equals_sequential(spark, seed):
    rng = random.Random(seed)
    costs = [(t, w, rng.randrange(30)) for t in range(15) for w in range(12) if rng.random() < 0.8]
    used_t, used_w, want = set(), set(), set()
    for c, t, w in sorted((c, t, w) for t, w, c in costs):
        if t not in used_t and w not in used_w:
            want.add((t, w, c))
            used_t.add(t)
            used_w.add(w)
    got = network.greedy_assignment(spark.createDataFrame(costs, "task LONG, worker LONG, cost LONG"), ties="id")
    assert {tuple(r) for r in got.collect()} == want


@pytest.fixture
def staged(monkeypatch):
    """Counts the staged jobs of the network operators."""
    calls = []
    plain = network.cut_lineage
    monkeypatch.setattr(network, "cut_lineage", lambda df: calls.append(1) or plain(df))
    return calls


def test_rounds_do_not_grow_with_equal_costs(spark, staged):
    flat = spark.range(32 * 32).selectExpr("id div 32 as task", "id % 32 as worker", "cast(5 as bigint) as cost")
    assert network.greedy_assignment(flat).count() == 32
    assert len(staged) < 30


def test_rounds_do_not_grow_with_a_ring(spark, staged):
    ring = spark.range(64).selectExpr("id as a", "(id + 1) % 64 as b")
    groups = network.conflict_free_groups(ring)
    assert network.grouping_audit(ring, groups).first().n_broken == 0
    assert len(staged) < 30


def test_one_dear_request_does_not_disturb_the_order(spark):
    demands = spark.createDataFrame([(c, 10) for c in range(21)], "customer_id LONG, demand LONG")
    depots = spark.createDataFrame([(0, 55, 0.0)], "warehouse_id LONG, capacity LONG, opening_cost DOUBLE")
    costs = spark.createDataFrame(
        [(c, 0, 1e9 if c == 20 else 1.0 + c / 100) for c in range(21)], "customer_id LONG, warehouse_id LONG, unit_cost DOUBLE"
    )
    shipped = {r.customer_id: r.amount for r in network.allocate_demand(demands, depots, costs).collect()}
    assert shipped == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 5}


def test_greedy_is_not_optimal(spark):
    costs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 100)], "task LONG, worker LONG, cost LONG")
    audit = {r.check: r.value for r in network.assignment_audit(costs, network.greedy_assignment(costs)).collect()}
    assert audit["total_cost"] == 101 and sum(audit.values()) == 101


def test_groups_have_no_conflict(spark):
    rng = random.Random(4)
    edges = [(a, b) for a in range(25) for b in range(a) if rng.random() < 0.3] + [(3, 3)]
    conflicts = spark.createDataFrame(edges, "a LONG, b LONG")
    lonely = spark.createDataFrame([(99,)], "node LONG")
    groups = network.conflict_free_groups(conflicts, lonely)
    found = {r.node: r.group for r in groups.collect()}
    assert 99 in found and all(found[a] != found[b] for a, b in edges if a != b)
    row = network.grouping_audit(conflicts, groups).first()
    assert (row.n_broken, row.n_ungrouped, row.n_nodes) == (0, 0, len(found))


def test_sessions_never_clash(spark):
    rows = [(c, s, (c + s) % 3, s % 2, 1 + s % 2) for c in range(3) for s in range(3)] + [(0, 0, 0, 0, 1)]
    req = spark.createDataFrame(rows, "class LONG, subject LONG, teacher LONG, room LONG, times LONG")
    sessions = network.place_sessions(req)
    periods = max(r.period for r in sessions.collect()) + 1
    assert all(r.violations == 0 for r in network.timetable_audit(req, sessions, periods).collect())
    late = {r.check: r.violations for r in network.timetable_audit(req, sessions, periods - 1).collect()}
    assert late["period_range"] > 0


def test_sessions_of_a_busy_teacher_are_placed_in_few_rounds(spark, monkeypatch):
    """One round a period before: 120 staged tables and more for the sessions of one teacher."""
    staged = []
    cut = network.cut_lineage
    monkeypatch.setattr(network, "cut_lineage", lambda df: staged.append(1) or cut(df))
    rows = [(c, c % 3, 0, c % 7, 1 + c % 2) for c in range(40)]
    req = spark.createDataFrame(rows, "class LONG, subject LONG, teacher LONG, room LONG, times LONG")
    sessions = network.place_sessions(req)
    assert len(staged) < 60
    assert all(r.violations == 0 for r in network.timetable_audit(req, sessions, 60 + 10).collect())
    assert network.place_sessions(req.where("false")).count() == 0


def test_sessions_without_a_room_are_placed(spark):
    """They were never placed before, and the rounds never ended."""
    req = spark.createDataFrame(
        [(c, 0, c % 2, None if c < 3 else c % 2, 1) for c in range(6)], "class LONG, subject LONG, teacher LONG, room LONG, times LONG"
    )
    sessions = network.place_sessions(req).collect()
    assert len({r["class"] for r in sessions}) == len(sessions) == 6
    for name in ("teacher", "room"):
        assert len({(r[name], r.period) for r in sessions}) == 6


def test_allocation_meets_demand_within_capacity(spark):
    rng = random.Random(6)
    demands = spark.createDataFrame([(c, rng.randrange(1, 40)) for c in range(40)], "customer_id LONG, demand LONG")
    depots = spark.createDataFrame([(w, 250, 10.0 * w) for w in range(4)], "warehouse_id LONG, capacity LONG, opening_cost DOUBLE")
    # warehouse 0 is cheapest for everyone
    costs = spark.createDataFrame(
        [(c, w, 1.0 + w + rng.random()) for c in range(40) for w in range(4)], "customer_id LONG, warehouse_id LONG, unit_cost DOUBLE"
    )
    shipped = network.allocate_demand(demands, depots, costs)
    row = network.allocation_summary(shipped, demands, depots, costs).first()
    assert row.shipped == row.demand and row.over_capacity == 0 and row.over_served == 0
    short = spark.createDataFrame([(0, 100, 0.0)], "warehouse_id LONG, capacity LONG, opening_cost DOUBLE")
    row = network.allocation_summary(
        network.allocate_demand(demands, short, costs), demands, short, costs
    ).first()
    assert row.shipped == 100


def test_conflicted_crew(spark):
    crew = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 10)], "vehicle LONG, employee LONG")
    conflicts = spark.createDataFrame([(10, 11), (11, 12)], "e1 LONG, e2 LONG")
    assert [tuple(r) for r in network.conflicted_vans(crew, conflicts).collect()] == [(1, 10, 11)]
