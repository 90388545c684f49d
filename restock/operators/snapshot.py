"""Training snapshot: one row per product, store and day with the next days' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.functions.numeric import log_units
from restock.operators.frames import value_in_days

def one_event_per_store_day(eventstores: DataFrame) -> DataFrame:
    """Two events may share a store-day; the smallest id stands for both so sales never repeat."""
    return eventstores.groupBy("es_s_id", "es_date").agg(F.min("es_e_id").alias("es_e_id"))


def labelled_sales(
    sales: DataFrame, eventstores: DataFrame, promotions: DataFrame, products: DataFrame
) -> DataFrame:
    """Sales with the day's event, promotion flag, product group and log units."""
    events = one_event_per_store_day(eventstores).select(
        F.col("es_s_id").alias("sa_s_id"), F.col("es_date").alias("sa_date"), "es_e_id"
    )
    promos = promotions.select(
        F.col("pr_p_id").alias("sa_p_id"),
        F.col("pr_s_id").alias("sa_s_id"),
        F.col("pr_date").alias("sa_date"),
        F.lit(True).alias("on_promo"),
    ).distinct()
    groups = products.select(F.col("p_id").alias("sa_p_id"), "p_group")
    return (
        sales.join(promos, ["sa_p_id", "sa_s_id", "sa_date"], "left")
        .join(events, ["sa_s_id", "sa_date"], "left")
        .join(groups, "sa_p_id", "left")
        .select(
            F.col("sa_date").alias("c_date"),
            F.col("sa_p_id").alias("product_id"),
            F.col("sa_s_id").alias("store_id"),
            log_units(F.col("sa_units_sold")).alias("log_units_sold"),
            F.col("p_group").alias("product_group"),
            F.col("es_e_id").alias("event_id"),
            F.coalesce("on_promo", F.lit(False)).alias("is_on_promo"),
        )
    )


def training_snapshot(
    sales: DataFrame,
    eventstores: DataFrame,
    promotions: DataFrame,
    products: DataFrame,
    date_from: str,
    date_upto: str,
    horizon: int = 7,
) -> DataFrame:
    """Rows of ``[date_from, date_upto]`` with events, promotions and log sales of the next days.

    Sales are cut to the wanted range plus ``horizon`` days before the windows, and to the exact
    range after them, so the look-ahead stays whole while the scan stays small.
    """
    first = F.lit(date_from).cast("date")
    last = F.lit(date_upto).cast("date")
    wide = sales.filter(F.col("sa_date").between(first, F.date_add(last, horizon)))
    labelled = labelled_sales(wide, eventstores, promotions, products)
    steps = range(1, horizon + 1)
    ahead = {
        **{f"next_{h}d_event_id": value_in_days("event_id", h) for h in steps},
        **{
            f"next_{h}d_is_on_promo": F.coalesce(value_in_days("is_on_promo", h), F.lit(False))
            for h in steps
        },
        **{f"h{h}_log_units_sold": value_in_days("log_units_sold", h) for h in steps},
    }
    return (
        labelled.select("*", *[column.alias(name) for name, column in ahead.items()])
        .filter(F.col("c_date").between(first, last))
        .drop("event_id", "is_on_promo")
    )
