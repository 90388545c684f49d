"""Planning inputs and dashboard tables. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.operators.relational import active_days, full_grid
from restock.operators.reshape import planning_calendar, with_calendar


def as_date(day: str):
    return F.lit(day).cast("date")


def name_to_id(table: DataFrame, name_col: str, id_col: str) -> DataFrame:
    return table.select(name_col, id_col)


# --- planning inputs ---------------------------------------------------------------------------


def procurement_needs(
    products: DataFrame,
    stores: DataFrame,
    predictions: DataFrame,
    procurements: DataFrame,
    date_from: str,
    window: int = 7,
) -> DataFrame:
    """Every product, store and planning day: predicted units and whether an order is allowed.

    Both fact tables are cut to the planning days before they are joined; procurement windows become
    the planning days they cover, so overlapping windows give one row.
    """
    first, last = F.date_add(as_date(date_from), 1), F.date_add(as_date(date_from), window)
    grid = with_calendar(
        full_grid(stores.select("s_id"), products.select("p_id")), date_from, window
    )
    expected = predictions.filter(F.col("dp_date").between(first, last)).select(
        F.col("dp_p_id").alias("p_id"),
        F.col("dp_s_id").alias("s_id"),
        F.col("dp_date").alias("c_date"),
        F.col("dp_mean").alias("pred_units_sold"),
    )
    may_order = (
        active_days(
            procurements.select(
                F.col("pc_p_id").alias("p_id"),
                F.col("pc_s_id").alias("s_id"),
                "pc_active_from",
                "pc_active_upto",
            ),
            "pc_active_from",
            "pc_active_upto",
            first,
            last,
            "c_date",
        )
        .select("p_id", "s_id", "c_date", F.lit(True).alias("active"))
        .distinct()
    )
    cell = ["p_id", "s_id", "c_date"]
    return (
        grid.join(expected, cell, "left")
        .join(may_order, cell, "left")
        .select(
            "p_id",
            "s_id",
            "c_rank",
            "pred_units_sold",
            F.coalesce("active", F.lit(False)).alias("needs_order"),
        )
    )


def current_stocks(stocks: DataFrame, date_from: str) -> DataFrame:
    return stocks.filter(F.col("sk_date") == as_date(date_from)).select(
        F.col("sk_p_id").alias("p_id"),
        F.col("sk_s_id").alias("s_id"),
        F.lit(0).alias("c_rank"),
        F.col("sk_units").alias("ending_inventory"),
    )


def links_by_day(transportlinks: DataFrame, date_from: str, window: int = 7) -> DataFrame:
    links = transportlinks.select(
        F.col("tl_p_id").alias("p_id"),
        F.col("tl_s_id").alias("s_id"),
        F.col("tl_w_id").alias("w_id"),
        F.col("tl_package_cost").alias("package_cost"),
        F.col("tl_package_size").alias("package_size"),
    )
    return with_calendar(links, date_from, window).drop("c_date")


def capacity_by_day(workshops: DataFrame, date_from: str, window: int = 7) -> DataFrame:
    rows = workshops.select("w_id", F.col("w_capacity").alias("capacity"))
    return with_calendar(rows, date_from, window).select("w_id", "c_rank", "capacity")


# --- dashboard tables --------------------------------------------------------------------------


def daily_plan(plans: DataFrame) -> DataFrame:
    """Planned deliveries per product, store and day over all workshops."""
    return plans.groupBy(
        F.col("pl_p_id").alias("p_id"), F.col("pl_s_id").alias("s_id"), F.col("pl_date").alias("c_date")
    ).agg(F.sum("pl_expected_units").alias("expected_units"))


def _named(df: DataFrame, products: DataFrame, stores: DataFrame, prefix: str) -> DataFrame:
    names_p = products.select(F.col("p_id").alias(f"{prefix}_p_id"), "p_name")
    names_s = stores.select(F.col("s_id").alias(f"{prefix}_s_id"), "s_name")
    return df.join(names_p, f"{prefix}_p_id", "left").join(names_s, f"{prefix}_s_id", "left")


def _fulfilment_with_plan(fulfilments: DataFrame, plans: DataFrame, how: str) -> DataFrame:
    plan = daily_plan(plans).toDF("df_p_id", "df_s_id", "df_date", "expected_units")
    return fulfilments.join(plan, ["df_p_id", "df_s_id", "df_date"], how)


def demand_evolution(
    fulfilments: DataFrame, plans: DataFrame, products: DataFrame, stores: DataFrame, date_from: str
) -> DataFrame:
    """Stock before deliveries, closing stock, met and unmet demand and deliveries after a date."""
    start = as_date(date_from)
    joined = _fulfilment_with_plan(
        fulfilments.filter(F.col("df_date") > start), plans.filter(F.col("pl_date") > start), "left"
    )
    delivered = F.coalesce("expected_units", F.lit(0))
    return _named(joined, products, stores, "df").select(
        "p_name",
        "s_name",
        F.col("df_date").alias("c_date"),
        (F.col("df_initial_stocks") - delivered).alias("initial_stocks"),
        F.col("df_closing_stocks").alias("closing_stocks"),
        F.col("df_met_demand").alias("met_demand"),
        F.col("df_unmet_demand").alias("unmet_demand"),
        delivered.alias("expected_units"),
    )


def store_locations(stores: DataFrame) -> DataFrame:
    return stores.select("s_name", "s_longitude", "s_latitude")


def workshop_locations(workshops: DataFrame) -> DataFrame:
    return workshops.select("w_name", "w_longitude", "w_latitude", "w_capacity")


def recent_sales(
    sales: DataFrame, products: DataFrame, stores: DataFrame, date_from: str, window: int = 21
) -> DataFrame:
    """Sales of the last days; ``units`` stands in for the stock level: units sold + 10."""
    last = as_date(date_from)
    recent = sales.filter(F.col("sa_date").between(F.date_sub(last, window), last))
    return _named(recent, products, stores, "sa").select(
        F.col("sa_date").alias("c_date"),
        "p_name",
        "s_name",
        F.col("sa_units_sold").alias("units_sold"),
        (F.col("sa_units_sold") + 10).alias("units"),
    )


def fulfilment_table(
    fulfilments: DataFrame, plans: DataFrame, products: DataFrame, stores: DataFrame
) -> DataFrame:
    """Fulfilment days that have a plan, for every product and store at once."""
    joined = _fulfilment_with_plan(fulfilments, plans, "inner")
    return _named(joined, products, stores, "df").select(
        F.col("df_date").alias("Date"),
        F.col("p_name").alias("Product"),
        F.col("s_name").alias("Store"),
        F.col("df_initial_stocks").alias("Initial Stocks"),
        F.col("df_closing_stocks").alias("Closing Stocks"),
        F.col("df_met_demand").alias("Fulfilled Sales"),
        F.col("df_unmet_demand").alias("Unfulfilled Sales"),
        F.col("expected_units").alias("Units To Deliver"),
    )


def demand_totals(fulfilment: DataFrame) -> DataFrame:
    """Met and unmet totals of every series of :func:`fulfilment_table`."""
    return fulfilment.groupBy("Product", "Store").agg(
        F.sum("Fulfilled Sales").alias("met_demand"), F.sum("Unfulfilled Sales").alias("unmet_demand")
    )


def shipments(
    plans: DataFrame, products: DataFrame, stores: DataFrame, workshops: DataFrame
) -> DataFrame:
    makers = workshops.select(F.col("w_id").alias("pl_w_id"), "w_name")
    return (
        _named(plans, products, stores, "pl")
        .join(makers, "pl_w_id", "left")
        .select(
            F.col("pl_date").alias("Date"),
            F.col("p_name").alias("Product"),
            F.col("s_name").alias("Store"),
            F.col("w_name").alias("Factory"),
            F.col("pl_expected_units").alias("Units"),
            F.lit("To Order").alias("Status"),
        )
    )


def sorted_names(table: DataFrame, name_col: str) -> DataFrame:
    return table.select(name_col).orderBy(name_col)


def stocks_with_names(stocks: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    return _named(stocks, products, stores, "sk").select("p_name", "s_name", "sk_date", "sk_units")


def balance_table(evolution: DataFrame, recent: DataFrame) -> DataFrame:
    """History and projection stacked by (series, day, measure); outflows are negative.

    Only series with a projection appear, as in a chart per projected series.
    """
    key = ["p_name", "s_name", "c_date"]
    history = recent.join(evolution.select("p_name", "s_name").distinct(), ["p_name", "s_name"], "left_semi")
    past = history.select(
        *key,
        F.col("units").cast("long").alias("inventory"),
        (-F.col("units_sold")).cast("long").alias("sales"),
    ).unpivot(key, ["inventory", "sales"], "measure", "units")
    ahead = evolution.select(
        *key,
        F.col("initial_stocks").cast("long").alias("projected_inventory"),
        F.col("expected_units").cast("long").alias("projected_deliveries"),
        (-F.col("met_demand")).cast("long").alias("projected_met"),
        (-F.col("unmet_demand")).cast("long").alias("projected_unmet"),
    )
    projected = ahead.unpivot(key, ahead.columns[len(key):], "measure", "units")
    return past.unionByName(projected)


def workshop_load(plans: DataFrame) -> DataFrame:
    """Units per workshop and day, then the busiest and quietest day of each workshop."""
    return (
        plans.groupBy("pl_w_id", "pl_date")
        .agg(F.sum("pl_expected_units").alias("units"))
        .groupBy("pl_w_id")
        .agg(F.max("units").alias("max_units"), F.min("units").alias("min_units"))
    )
