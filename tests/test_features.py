"""Window features against values computed row by row in Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from restock.functions.numeric import ewm_last, strip_first
from restock.operators import features, snapshot
from restock.operators.frames import value_in_days


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def series(spark):
    """Three series with gaps over 2011–2016, leap days included."""
    rng = random.Random(5)
    rows = []
    for store in (1, 2, 3):
        current = day("2011-01-01")
        while current <= day("2016-12-31"):
            if rng.random() < (0.9 if store < 3 else 0.2) or (current.month, current.day) == (2, 29):
                rows.append((7, store, current, rng.random() * 5))
            current += dt.timedelta(days=1)
    df = spark.createDataFrame(rows, "product_id INT, store_id INT, c_date DATE, x DOUBLE")
    by_key = {(s, d): x for _, s, d, x in rows}
    return df, by_key


def weighted(values):
    """Newest first."""
    weights = [0.1**i for i in range(len(values))]
    return sum(w * v for w, v in zip(weights, values)) / sum(weights)


def years_back(d, n):
    try:
        return d.replace(year=d.year - n)
    except ValueError:
        return d.replace(year=d.year - n, day=28)


def yearly(by_key, store, d):
    oldest = years_back(d, 3)
    found = [
        by_key[(store, e)]
        for n in range(4)
        for e in [dt.date(d.year - n, 1, 1) + dt.timedelta(days=d.timetuple().tm_yday - 1)]
        if e.year == d.year - n and e > oldest and (store, e) in by_key
    ]
    return weighted(found)


def test_ewm_of_one_two_three(spark):
    got = spark.range(1).select(ewm_last(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("v")).first().v
    assert got == pytest.approx(2.891891891891892)


def test_rolling_columns(series):
    df, by_key = series
    got = df.select("*", *[c.alias(n) for n, c in features.rolling_columns("x", [3, 28]).items()])
    for r in got.filter("c_date >= '2015-12-01' AND c_date <= '2016-03-05'").collect():
        for n in (3, 28):
            days = [r.c_date - dt.timedelta(days=i) for i in range(n - 1, -1, -1)]
            window = [by_key[(r.store_id, d)] for d in days if (r.store_id, d) in by_key]
            tag = f"{n}d_x"
            assert r[f"mean_{tag}"] == pytest.approx(statistics.fmean(window))
            assert r[f"median_{tag}"] == pytest.approx(statistics.median(window))
            assert r[f"min_{tag}"] == min(window) and r[f"max_{tag}"] == max(window)
            if len(window) > 1:
                assert r[f"std_{tag}"] == pytest.approx(statistics.stdev(window))
                steps = [b - a for a, b in zip(window, window[1:])]
                assert r[f"diff_mean_{tag}"] == pytest.approx(statistics.fmean(steps))
            else:
                assert r[f"std_{tag}"] is None and r[f"diff_mean_{tag}"] is None


def test_yearly_ewm_and_lookup_over_leap_years(series):
    df, by_key = series
    scored = df.withColumn("ewm", features.yearly_ewm("x"))
    scored = scored.withColumns({f"h{h}": features.seasonal_lookup("ewm", h) for h in (1, 7)})
    expected = {(s, d): yearly(by_key, s, d) for s, d in by_key}
    source = {}
    for (s, d), value in expected.items():
        if (d.month, d.day) != (2, 29):
            source[(s, d.replace(year=d.year + 1))] = value
    for r in scored.collect():
        assert r.ewm == pytest.approx(expected[(r.store_id, r.c_date)])
        for h in (1, 7):
            want = source.get((r.store_id, r.c_date + dt.timedelta(days=h)))
            assert (r[f"h{h}"] is None) == (want is None)
            if want is not None:
                assert r[f"h{h}"] == pytest.approx(want)


def test_same_day_mean(series):
    df, by_key = series
    got = df.select("*", features.same_day_mean("x", 4).alias("m")).filter("c_date >= '2015-01-01'")
    for r in got.collect():
        oldest = years_back(r.c_date, 4)
        found = [
            x for (s, d), x in by_key.items()
            if s == r.store_id and d.timetuple().tm_yday == r.c_date.timetuple().tm_yday and oldest <= d < r.c_date
        ]
        assert (r.m is None) == (not found)
        if found:
            assert r.m == pytest.approx(statistics.fmean(found))


def test_gaps_and_nulls(spark):
    days = ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04", "2020-01-06", "2020-01-07"]
    values = [1, 2, None, None, 5, 6]
    rows = [(10, 3, day(d), v) for d, v in zip(days, values)] + [
        (10, 2, day("2020-01-01"), 1),
        (10, 2, day("2020-01-02"), None),
    ]
    df = spark.createDataFrame(rows, "product_id INT, store_id INT, c_date DATE, b INT")
    got = features.forward_fill(
        df.withColumns({"low": features.two_row_min("b"), "list": features.trailing_list("b", 2)}), ["b"]
    ).orderBy("store_id", "c_date").collect()
    assert [r.b for r in got] == [1, 1, 1, 2, 2, 2, 5, 6]
    assert [r.low for r in got] == [None, None, None, 1, None, None, None, 5]
    assert [[x for x in r.list if x is not None] for r in got] == [[1], [1], [1], [1, 2], [2], [], [5], [5, 6]]


def test_look_ahead_reads_the_exact_day(series):
    df, by_key = series
    for r in df.select("*", value_in_days("x", 3).alias("v")).limit(300).collect():
        assert r.v == by_key.get((r.store_id, r.c_date + dt.timedelta(days=3)))


def test_two_events_do_not_repeat_sales(spark):
    sales = spark.createDataFrame(
        [(1, 1, day("2020-01-01"), 3), (1, 1, day("2020-01-02"), 5)],
        "sa_p_id INT, sa_s_id INT, sa_date DATE, sa_units_sold INT",
    )
    events = spark.createDataFrame(
        [(9, 1, day("2020-01-02")), (4, 1, day("2020-01-02"))], "es_e_id INT, es_s_id INT, es_date DATE"
    )
    promos = spark.createDataFrame([(1, 1, day("2020-01-02"))], "pr_p_id INT, pr_s_id INT, pr_date DATE")
    products = spark.createDataFrame([(1, "g")], "p_id INT, p_group STRING")
    rows = snapshot.training_snapshot(
        sales, events, promos, products, "2020-01-01", "2020-01-01"
    ).collect()
    assert len(rows) == 1
    assert rows[0].next_1d_event_id == 4
    assert rows[0].next_1d_is_on_promo is True and rows[0].next_2d_is_on_promo is False
    assert rows[0].h1_log_units_sold == pytest.approx(math.log(6))


def test_strip_first_only_removes_one(spark):
    df = spark.createDataFrame([("a Traslado b Traslado c",), ("x.",), (None,)], "t STRING")
    got = [r[0] for r in df.select(strip_first(F.col("t"), "Traslado ")).collect()]
    assert got == ["a b Traslado c", "x.", None]


def test_feature_matrix_needs_one_shuffle_of_the_series(series):
    df, _ = series
    snap = df.withColumnsRenamed({"x": "log_units_sold"}).withColumns(
        {f"h{h}_log_units_sold": value_in_days("log_units_sold", h) for h in range(1, 8)}
    )
    plan = features.feature_matrix(snap, "2015-01-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "Python" not in plan
