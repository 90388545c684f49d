"""Validated loads: all or nothing, ids, patches, strict names."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from restock.operators import integrity
from restock.operators.relational import strict_map, unmatched_names

D = dt.date(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    store = integrity.CoreStore(spark, str(tmp_path))
    store.append("products", spark.createDataFrame([("bread", "bakery"), ("eggs", "eggs")], "p_name STRING, p_group STRING"))
    store.append("stores", spark.createDataFrame([("north", 10.0, 5.0)], "s_name STRING, s_longitude DOUBLE, s_latitude DOUBLE"))
    return store


def sales(spark, rows):
    return spark.createDataFrame(rows, "sa_p_id LONG, sa_s_id LONG, sa_date DATE, sa_units_sold INT").repartition(3)


def test_append_numbers_rows_and_fills_defaults(spark, store):
    assert sorted(r.p_id for r in store.table("products").collect()) == [1, 2]
    assert {r.p_is_perishable for r in store.table("products").collect()} == {False}
    first = store.append("sales", sales(spark, [(1, 1, D, 4), (2, 1, D, 5)]))
    second = store.append("sales", sales(spark, [(1, 1, dt.date(2024, 1, 2), 4)]))
    assert first.written and sorted(r.sa_id for r in first.ids.collect()) == [1, 2]
    assert [r.sa_id for r in second.ids.collect()] == [3]


def test_patch_refuses_an_id_named_twice(spark, store):
    changes = spark.createDataFrame([(1, "a"), (1, "b")], "p_id LONG, p_group STRING")
    with pytest.raises(ValueError, match="more than once"):
        store.patch("products", changes)


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([(1, 1, D, 4), (1, 1, D, 5)], "unique"),
        ([(9, 1, D, 4), (1, 1, D, 5)], "reference sa_p_id"),
        ([(1, 1, D, -4)], "check units_sold"),
        ([(1, 1, None, 4)], "check required sa_date"),
    ],
)
def test_bad_batch_changes_nothing(spark, store, rows, rule):
    store.append("sales", sales(spark, [(2, 1, D, 1)]))
    result = store.append("sales", sales(spark, rows))
    assert not result.written
    assert rule in {r.rule for r in result.violations.collect()}
    assert store.table("sales").count() == 1


def test_stored_key_is_refused(spark, store):
    store.append("sales", sales(spark, [(1, 1, D, 1)]))
    assert not store.append("sales", sales(spark, [(1, 1, D, 2)])).written


def test_empty_batch(spark, store):
    with pytest.raises(ValueError):
        store.append("sales", sales(spark, [(1, 1, D, 1)]).limit(0))
    assert integrity.batch_or_none(sales(spark, [(1, 1, D, 1)]).limit(0)) is None


def test_patch(spark, store):
    changes = spark.createDataFrame([(1, None, "food"), (7, "x", "y")], "p_id LONG, p_name STRING, p_group STRING")
    unknown = store.patch("products", changes)
    assert [r.p_id for r in unknown.collect()] == [7]
    assert {(r.p_name, r.p_group) for r in store.table("products").collect()} == {("bread", "food"), ("eggs", "eggs")}
    with pytest.raises(ValueError):
        store.patch("products", spark.createDataFrame([(1, "eggs")], "p_id LONG, p_name STRING"))
    assert {r.p_name for r in store.table("products").collect()} == {"bread", "eggs"}


def test_strict_map_refuses_unknown_names(spark, store):
    batch = spark.createDataFrame([("bread",), ("cheese",)], "p_name STRING")
    products = store.table("products")
    assert [r.p_name for r in unmatched_names(batch, "p_name", products, "p_name").collect()] == ["cheese"]
    with pytest.raises(PySparkException, match="cheese"):
        strict_map(batch, "p_name", products, "p_name", "p_id").collect()


def rows(store, name):
    return sorted(tuple(r) for r in store.table(name).collect())


def test_a_run_that_is_started_again_loads_nothing_twice(spark, store, monkeypatch):
    batch = lambda: sales(spark, [(1, 1, D, 4), (2, 1, D, 5)])
    store.append("sales", sales(spark, [(1, 1, dt.date(2023, 1, 1), 9)]))
    real = integrity.CoreStore._mark

    def stop_before_done(self, name, run, mark):
        if mark == "done":
            raise OSError("lost")
        real(self, name, run, mark)

    monkeypatch.setattr(integrity.CoreStore, "_mark", stop_before_done)
    with pytest.raises(OSError):
        store.append_once("sales", batch, "week 1")  # rows are there, the mark is not
    assert len(rows(store, "sales")) == 3
    monkeypatch.setattr(integrity.CoreStore, "_mark", real)
    for _ in range(2):
        assert store.append_once("sales", batch, "week 1").written
        assert [r[0] for r in rows(store, "sales")] == [1, 2, 3]
    more = lambda: sales(spark, [(1, 1, dt.date(2024, 1, 9), 1)])
    assert store.append_once("sales", more, "week 2").written and len(rows(store, "sales")) == 4


def test_files_of_an_unfinished_first_load_are_taken_back(spark, tmp_path, store, monkeypatch):
    def half(self, name, batch):
        batch.limit(1).write.parquet(f"{self.root}/{name}/v0")
        (tmp_path / name / "v0" / "_SUCCESS").unlink()
        raise OSError("lost")

    batch = lambda: spark.createDataFrame([("w1", 5), ("w2", 6)], "w_name STRING, w_capacity INT")
    with monkeypatch.context() as broken:
        broken.setattr(integrity.CoreStore, "append", half)
        with pytest.raises(OSError):
            store.append_once("workshops", batch, "week 1")
    assert store.append_once("workshops", batch, "week 1").written
    assert [r[0] for r in rows(store, "workshops")] == [1, 2]


def test_a_weekly_load_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from restock.plans import weekly_run
    from restock.sources import tables

    frame = spark.createDataFrame
    landing = {
        "products": frame([("bread", "bakery"), ("eggs", "eggs")], "p_name STRING, p_group STRING"),
        "stores": frame([("north",), ("south",)], "s_name STRING"),
        "workshops": frame([("w", 10)], "w_name STRING, w_capacity INT"),
        "events": frame([("fair",)], "e_name STRING"),
        "transportlinks": frame([("bread", "north", "w", 1.0, 5)], "p_name STRING, s_name STRING, w_name STRING, tl_package_cost DOUBLE, tl_package_size INT"),
        "procurements": frame([("bread", "north", D, dt.date(2024, 2, 1))], "p_name STRING, s_name STRING, pc_active_from DATE, pc_active_upto DATE"),
        "promotions": frame([("eggs", "north", D)], "p_name STRING, s_name STRING, pr_date DATE"),
        "eventstores": frame([("north", "fair", D)], "s_name STRING, e_name STRING, es_date DATE"),
        "stocks": frame([("bread", "south", D, 4)], "p_name STRING, s_name STRING, sk_date DATE, sk_units INT"),
        "sales": frame([("bread", "south", D, 4), ("eggs", "north", D, 2)], "p_name STRING, s_name STRING, sa_date DATE, sa_units_sold INT"),
    }
    for name, df in landing.items():
        tables.write_parquet(df.coalesce(1), tables.landing_path(str(tmp_path / "landing"), "2024-01-08", name))

    def load(root, failures):
        store = integrity.CoreStore(spark, str(tmp_path / root))
        real = integrity.CoreStore.append
        left = [failures]

        def append(self, name, batch):
            result = real(self, name, batch)
            if left[0] and name in ("stores", "promotions", "sales") and name not in stopped:
                stopped.add(name)
                raise OSError("lost")  # after the rows, before the mark
            return result

        stopped: set[str] = set()
        monkeypatch.setattr(integrity.CoreStore, "append", append)
        for _ in range(5):
            try:
                weekly_run.load_batch(store, str(tmp_path / "landing"), "2024-01-08")
                break
            except OSError:
                continue
        monkeypatch.setattr(integrity.CoreStore, "append", real)
        assert not failures or stopped == {"stores", "promotions", "sales"}
        return {name: rows(store, name) for name in landing}

    assert load("whole", 0) == load("stopped", 1)
