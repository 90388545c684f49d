"""The replenishment plan keeps its rules and does not depend on partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from restock.operators import planning


def make_inputs(spark, parts):
    rng = random.Random(3)
    pairs = [(p, s) for p in range(12) for s in range(4)]
    needs = [
        (p, s, t, rng.choice([None, 0, 5, 30, 130]), rng.random() < 0.9) for p, s in pairs for t in (1, 2)
    ]
    stocks = [(p, s, rng.randrange(90)) for p, s in pairs if rng.random() < 0.7]
    # workshop 0 is cheapest for everyone: one hot workshop
    links = [(p, s, w, 0.1 + w, rng.randrange(4, 20)) for p, s in pairs for w in range(2)]
    capacity = [(w, t, 400) for w in range(2) for t in (1, 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(parts)
    return planning.PlanInputs(
        frame(needs, "p_id INT, s_id INT, c_rank INT, pred_units_sold INT, needs_order BOOLEAN"),
        frame(stocks, "p_id INT, s_id INT, ending_inventory INT"),
        frame(links, "p_id INT, s_id INT, w_id INT, package_cost DOUBLE, package_size INT"),
        frame(capacity, "w_id INT, c_rank INT, capacity INT"),
    )


@pytest.fixture(scope="module")
def planned(spark):
    inputs = make_inputs(spark, 3)
    return inputs, *planning.replenishment_plan(inputs, window=2)


def test_rules_hold(planned):
    inputs, orders, cells = planned
    audit = {r["constraint"]: r.violations for r in planning.audit_plan(cells, orders, inputs).collect()}
    hard = {"balance", "demand_split", "order_allowed", "package_multiple", "capacity"}
    assert {name: audit[name] for name in hard} == dict.fromkeys(hard, 0)
    assert audit["no_prediction"] > 0


def test_capacity_is_used_up_before_demand_is_refused(planned):
    _, orders, _ = planned
    load = {(r.w_id, r.c_rank): r.u for r in orders.groupBy("w_id", "c_rank").agg(F.sum("units").alias("u")).collect()}
    # the first day asks for more than both workshops have; only part of a package may stay free
    assert load[(0, 1)] > 380 and load[(1, 1)] > 380


def test_an_empty_plan_leaves_capacity_idle(planned):
    inputs, orders, cells = planned
    assert planning.idle_capacity(cells, orders, inputs).first().violations == 0
    demand = planning.cell_demand(inputs.needs)
    empty = demand.select(*planning.CELL, "demand", F.lit(0).alias("orders"), F.lit(0).alias("opening_stocks"))
    assert planning.idle_capacity(empty, orders.limit(0), inputs).first().violations > 0


def test_plan_does_not_depend_on_partitioning(spark, planned):
    _, orders, cells = planned
    orders2, cells2 = planning.replenishment_plan(make_inputs(spark, 7), window=2)
    rows = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert rows(orders) == rows(orders2)
    assert rows(cells) == rows(cells2)


def test_audit_finds_broken_rules(planned):
    inputs, orders, cells = planned
    wrong = cells.withColumn("closing_stocks", F.col("closing_stocks") + 1)
    too_much = orders.withColumn("units", F.col("units") + 1)
    audit = {r["constraint"]: r.violations for r in planning.audit_plan(wrong, too_much, inputs).collect()}
    assert audit["balance"] > 0 and audit["package_multiple"] > 0
