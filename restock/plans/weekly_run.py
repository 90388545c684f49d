"""The weekly run: landing batch → core tables → snapshot → features → model → predictions → plan
→ dashboard table. Stages hand over parquet. A failed run is started again on the same ``root``: tables that it has
loaded are left alone, a table that it was loading is taken back first, later stages overwrite their files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.operators import features, forecast, integrity, planning, snapshot
from restock.operators.priced_plan import priced_plan
from restock.operators.reshape import planning_calendar
from restock.plans import reports
from restock.schemas import CORE_TABLES
from restock.session import cut_lineage
from restock.sources import tables

INDEPENDENT = ("products", "stores", "workshops", "events")
LANDED = ("transportlinks", "procurements", "promotions", "eventstores", "stocks", "sales")


def name_columns(table: str) -> dict[str, tuple[str, str, str, str]]:
    """{name column in the landing file: (dimension, name column, id column, core column)}, from the references."""
    found = {}
    for core_column, (dimension, id_column) in CORE_TABLES[table].references.items():
        name = id_column.replace("_id", "_name")
        found[name] = (dimension, name, id_column, core_column)
    return found


DEPENDENT = {table: name_columns(table) for table in LANDED}


@dataclass(frozen=True)
class WeeklyParams:
    timestamp: str
    train_from: str
    train_upto: str
    split_date: str
    horizon: int = 7
    window: int = 7
    n_trials: int = 30
    fixed_params: Mapping = field(default_factory=lambda: dict(forecast.FIXED_PARAMS))
    limits: planning.PlanLimits = planning.PlanLimits()


def _append(store: integrity.CoreStore, name: str, batch: Callable[[], DataFrame], run: str) -> None:
    result = store.append_once(name, batch, run)
    if not result.written:
        raise ValueError(f"{name}: {result.violations.first().asDict()}")


def load_batch(store: integrity.CoreStore, landing: str, timestamp: str) -> list[str]:
    """Load every table of a landing batch, dimensions first; empty tables are skipped."""
    loaded = []
    for name in (*INDEPENDENT, *DEPENDENT):
        batch = integrity.batch_or_none(tables.read_landing(store.spark, landing, timestamp, name))
        if batch is None:
            continue

        def mapped(name=name, batch=batch) -> DataFrame:
            names = DEPENDENT.get(name, {})
            mappers = {c: (store.table(d), n, i) for c, (d, n, i, _) in names.items()}
            renames = {c: target for c, (_, _, _, target) in names.items()}
            return integrity.map_batch(batch, mappers, renames)

        _append(store, name, mapped, timestamp)
        loaded.append(name)
    return loaded


def build_matrix(store: integrity.CoreStore, folder: str, params: WeeklyParams) -> DataFrame:
    """Snapshot and feature matrix as parquet; the matrix is stored by train / valid part."""
    spark = store.spark
    snap = snapshot.training_snapshot(
        store.table("sales"),
        store.table("eventstores"),
        store.table("promotions"),
        store.table("products"),
        params.train_from,
        params.train_upto,
        params.horizon,
    )
    tables.write_parquet(snap, f"{folder}/train_snapshot")
    matrix = features.feature_matrix(
        tables.scan_parquet(spark, f"{folder}/train_snapshot"), params.split_date, horizon=params.horizon
    )
    tables.write_parquet(matrix, f"{folder}/matrix", partition_by=["is_valid"])
    # partition values come back as text
    return tables.scan_parquet(spark, f"{folder}/matrix").withColumn(
        "is_valid", F.col("is_valid").cast("boolean")
    )


def learn(matrix: DataFrame, folder: str, params: WeeklyParams) -> forecast.MultiHorizonForecaster:
    """Search parameters, refit on everything with the best ones, return the stored model."""
    train, valid = matrix.filter("not is_valid"), matrix.filter("is_valid")
    trials = forecast.search(
        train, valid, params.n_trials, params.fixed_params, horizons=params.horizon
    )
    tables.write_parquet(trials, f"{folder}/trials")
    best = forecast.best_params(tables.scan_parquet(matrix.sparkSession, f"{folder}/trials"))
    forecast.refit_and_register(train, valid, best, folder, "demand_predictor", params.horizon)
    return forecast.load_latest(matrix.sparkSession, folder, "demand_predictor")


def plan_week(store: integrity.CoreStore, params: WeeklyParams) -> DataFrame:
    """Write fulfilment and procurement plan; returns the audit of the plan."""
    day, window = params.timestamp, params.window
    links = store.table("transportlinks").select(
        F.col("tl_p_id").alias("p_id"),
        F.col("tl_s_id").alias("s_id"),
        F.col("tl_w_id").alias("w_id"),
        F.col("tl_package_cost").alias("package_cost"),
        F.col("tl_package_size").alias("package_size"),
    )
    inputs = planning.PlanInputs(
        cut_lineage(
            reports.procurement_needs(
                store.table("products"),
                store.table("stores"),
                store.table("demandpredictions"),
                store.table("procurements"),
                day,
                window,
            )
        ),
        cut_lineage(reports.current_stocks(store.table("stocks"), day)),
        links,
        reports.capacity_by_day(store.table("workshops"), day, window),
    )
    planned = priced_plan(inputs, window, params.limits)
    orders, cells = planned.orders, planned.cells
    calendar = planning_calendar(store.spark, day, window)
    _append(store, "demandfulfillments", lambda: planning.fulfilment_rows(cells, calendar), day)
    plan = integrity.batch_or_none(planning.procurement_rows(orders, calendar))
    if plan is not None:
        _append(store, "procurementplans", lambda: plan, day)
    return planning.audit_plan(cells, orders, inputs, params.limits)


def run_week(
    spark: SparkSession, landing: str, root: str, params: WeeklyParams
) -> tuple[integrity.CoreStore, DataFrame, DataFrame]:
    """Run every stage; returns (core store, plan audit, dashboard balance table)."""
    store = integrity.CoreStore(spark, f"{root}/core")
    folder = f"{root}/runs/{params.timestamp}"
    load_batch(store, landing, params.timestamp)
    matrix = build_matrix(store, folder, params)
    model = learn(matrix, folder, params)
    predictions = integrity.batch_or_none(forecast.score_day(model, matrix, params.timestamp))
    if predictions is not None:  # a day without sales has none
        _append(store, "demandpredictions", lambda: predictions, params.timestamp)
    audit = plan_week(store, params)
    products, stores = store.table("products"), store.table("stores")
    evolution = reports.demand_evolution(
        store.table("demandfulfillments"), store.table("procurementplans"), products, stores, params.timestamp
    )
    recent = reports.recent_sales(store.table("sales"), products, stores, params.timestamp)
    tables.write_parquet(
        reports.balance_table(evolution, recent), f"{folder}/balance", partition_by=["s_name"]
    )
    return store, audit, tables.scan_parquet(spark, f"{folder}/balance")
