"""Forecaster behaviour on a small learnable table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from restock.operators import forecast


@pytest.fixture(scope="module")
def matrix(spark):
    rows = []
    for i in range(240):
        x = float(i % 12)
        rows.append((i % 3, 1, dt.date(2024, 1, 1) + dt.timedelta(days=i), "g" + str(i % 2), x, x / 2, None if i > 230 else x / 3))
    schema = "product_id INT, store_id INT, c_date DATE, product_group STRING, x DOUBLE, h1_log_units_sold DOUBLE, h2_log_units_sold DOUBLE"
    return spark.createDataFrame(rows, schema)


def test_fit_predict_score(spark, matrix, tmp_path):
    model = forecast.MultiHorizonForecaster(2, {"maxIter": 3, "maxDepth": 4}).fit(matrix)
    scored = model.predict(matrix)
    assert scored.count() == 240 and set(matrix.columns) < set(scored.columns)
    row = forecast.evaluate(scored, forecast.target_columns(2)).first()
    assert row.h1_log_units_sold_r2 > 0.9
    top = forecast.ranked_importances(model.feature_importances(spark)).first()
    assert top.feature_name == "x"
    model.save(str(tmp_path / "m"))
    again = forecast.MultiHorizonForecaster.load(spark, str(tmp_path / "m")).predict(matrix)
    pair = scored.select("c_date", "pred_h2_log_units_sold").join(
        again.select("c_date", F.col("pred_h2_log_units_sold").alias("b")), "c_date"
    )
    assert pair.filter("pred_h2_log_units_sold != b").count() == 0
    day = forecast.score_day(model, matrix, "2024-02-01").collect()
    assert [r.dp_date for r in day] == [dt.date(2024, 2, 2), dt.date(2024, 2, 3)]
    assert all(r.dp_mean >= 0 for r in day)


def test_every_category_is_kept(spark):
    rows = [(i % 100, 1, dt.date(2024, 1, 1), "g" + str(i % 70), float(i % 100), float(i % 100 % 2)) for i in range(600)]
    schema = "product_id INT, store_id INT, c_date DATE, product_group STRING, x DOUBLE, h1_log_units_sold DOUBLE"
    df = spark.createDataFrame(rows, schema)
    model = forecast.MultiHorizonForecaster(1, {"maxIter": 2, "maxDepth": 3})
    model.fit(df.filter("product_id < 90"), valid=df.filter("product_id >= 90"))
    indexer = next(s for s in model.encoder.stages if hasattr(s, "categoryMaps"))
    sizes = {k: len(v) for k, v in indexer.categoryMaps.items()}
    assert sizes == {0: 100, 1: 1, 2: 70}
    assert model.predict(df).count() == 600


def test_typed_parameters_lose_nothing(spark):
    long = "9" * 25
    df = spark.createDataFrame([("12",), ("123456789012",), (long,), ("1.5",), ("a.b",), ("x",)], "value STRING")
    rows = {r.value: (r.as_int, r.as_float, r.as_text) for r in forecast.typed_parameters(df, "value").collect()}
    assert rows == {
        "12": (12, None, None),
        "123456789012": (123456789012, None, None),
        long: (None, None, long),
        "1.5": (None, 1.5, None),
        "a.b": (None, None, "a.b"),
        "x": (None, None, "x"),
    }


def test_search_shares_its_vectors(matrix):
    trials = forecast.search(matrix.filter("product_id < 2"), matrix.filter("product_id = 2"), 2, {"maxIter": 2, "maxDepth": 2}, horizons=2)
    assert trials.count() == 2 and forecast.best_trial(trials).count() == 1


def test_errors(matrix):
    with pytest.raises(RuntimeError):
        forecast.MultiHorizonForecaster(2).predict(matrix)
    with pytest.raises(ValueError):
        forecast.MultiHorizonForecaster(3).fit(matrix, forecast.target_columns(2))


def test_draws_are_seeded_and_in_range():
    draws = forecast.draw_params(20)
    assert draws == forecast.draw_params(20)
    assert all(1e-5 <= d["stepSize"] <= 0.2 and d["minInstancesPerNode"] in range(5, 51, 5) for d in draws)


def test_evaluate_against_hand_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 3.0), (None, 1.0), (9.0, None)], "h1_log_units_sold DOUBLE, pred_h1_log_units_sold DOUBLE")
    row = forecast.evaluate(df, ["h1_log_units_sold"]).first()
    assert row.h1_log_units_sold_l2 == pytest.approx(4 / 3)
    assert row.h1_log_units_sold_r2 == pytest.approx(1 - 4 / 2)
