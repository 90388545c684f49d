"""Bucketed running totals and the grid stay right when one group holds most rows."""

import random
from collections import defaultdict

from restock.operators.relational import full_grid, interval_join
from restock.operators.running import bucketed_running_total


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(9), i, rng.randrange(20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, b INT, k INT, v INT").repartition(7)
    got = bucketed_running_total(df, ["g"], ["b"], ["k"], "v", "total").collect()
    assert len(got) == len(rows)
    want, sums = {}, defaultdict(int)
    for g, b, k, v in sorted(rows):
        sums[g] += v
        want[k] = sums[g]
    assert {r.k: r.total for r in got} == want


def test_row_window_is_per_bucket(spark):
    df = spark.createDataFrame([("a", 1, 1, 1)], "g STRING, b INT, k INT, v INT")
    plan = bucketed_running_total(df, ["g"], ["b"], ["k"], "v", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum(v" in plan


def test_full_grid_has_every_pair_once(spark):
    left = spark.range(13).toDF("a")
    right = spark.range(57).toDF("b")
    grid = full_grid(left, right)
    assert grid.count() == 13 * 57 == grid.distinct().count()
    assert "CartesianProduct" not in grid._jdf.queryExecution().executedPlan().toString()


def test_interval_join_matches_pairwise_comparison(spark):
    rng = random.Random(8)
    facts = [(k, rng.randrange(60)) for k in range(3) for _ in range(20)]
    windows = [(k, a, a + rng.randrange(1, 15)) for k in range(3) for a in range(0, 60, 9)]
    d0 = "date_add(date'2024-01-01', {})"
    f = spark.createDataFrame(facts, "k INT, n INT").selectExpr("k", f"{d0.format('n')} AS day").distinct()
    w = spark.createDataFrame(windows, "k INT, a INT, b INT").selectExpr(
        "k", f"{d0.format('a')} AS lo", f"{d0.format('b')} AS hi"
    )
    got = interval_join(f, w, ["k"], "day", "lo", "hi")
    want = f.alias("f").join(
        w.alias("w"), (f["k"] == w["k"]) & (w["lo"] <= f["day"]) & (f["day"] < w["hi"]), "left"
    ).select("f.k", "f.day", "w.lo", "w.hi")
    rows = lambda df: sorted(map(tuple, df.select("k", "day", "lo", "hi").collect()), key=repr)
    assert rows(got) == rows(want)
    # no facts: no day range, so an open-ended window must not be exploded
    endless = spark.sql("SELECT 1 AS k, date'2024-01-01' AS lo, date'9999-12-31' AS hi")
    assert interval_join(f.limit(0), endless, ["k"], "day", "lo", "hi").count() == 0
