"""Core retail tables derived from an order star schema (lineitem, part, supplier, …).

Product = part brand, store = region of the supplying nation, workshop = supplier group. Every
method returns a lazy DataFrame; joins carry no broadcast hints, so Spark picks the strategy from
the real sizes (and splits hot join keys at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.session import cut_lineage

WORKSHOP_GROUPS = 6


class StarSchema:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _lines(self, date_from: str | None = None, date_upto: str | None = None, ahead: int = 0) -> DataFrame:
        """Shipped lines with product, store and workshop ids. Bounds are compared with the raw
        ship timestamp so that they reach the parquet scan."""
        lines = self.raw("lineitem").select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_shipdate",
        )
        stamp = F.col("l_shipdate")
        if date_from:
            lines = lines.filter(stamp >= F.lit(date_from).cast("timestamp_ntz"))
        if date_upto:
            after = F.date_add(F.lit(date_upto).cast("date"), 1 + ahead).cast("timestamp_ntz")
            lines = lines.filter(stamp < after)
        part = self.raw("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("p_id"),
        )
        supplier = (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("l_suppkey"),
                F.col("n_regionkey").alias("s_id"),
                F.col("n_nationkey").alias("from_nation"),
                (F.col("s_suppkey") % WORKSHOP_GROUPS).cast("int").alias("w_id"),
            )
        )
        return lines.join(part, "l_partkey").join(supplier, "l_suppkey").withColumn(
            "day", stamp.cast("date")
        )

    def sales(self, date_from: str | None = None, date_upto: str | None = None) -> DataFrame:
        return (
            self._lines(date_from, date_upto)
            .groupBy(
                F.col("p_id").alias("sa_p_id"),
                F.col("s_id").alias("sa_s_id"),
                F.col("day").alias("sa_date"),
            )
            .agg(
                F.sum("l_quantity").cast("long").alias("sa_units_sold"),
                F.max("l_discount").alias("max_disc"),
            )
        )

    def daily_tables(
        self, date_from: str | None = None, date_upto: str | None = None, ahead: int = 0
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(sales, promotions, eventstores) from a single pass over the lines of the given days.

        ``ahead`` more days are read behind the last one; the bounds reach the scan.

        The daily aggregate is far smaller than the lines; it is staged once so that the three
        tables do not scan the lines again. Of several events on a store-day the smallest id stays.
        """
        campaign = F.when((F.col("l_discount") >= 0.095) & (F.col("l_tax") >= 0.075), F.col("l_linenumber"))
        daily = cut_lineage(
            self._lines(date_from, date_upto, ahead)
            .groupBy("p_id", "s_id", "day")
            .agg(
                F.sum("l_quantity").cast("long").alias("units"),
                F.max("l_discount").alias("max_disc"),
                F.min(campaign).alias("campaign"),
            )
        )
        sales = daily.select(
            F.col("p_id").alias("sa_p_id"),
            F.col("s_id").alias("sa_s_id"),
            F.col("day").alias("sa_date"),
            F.col("units").alias("sa_units_sold"),
        )
        promotions = daily.filter(F.col("max_disc") >= 0.09).select(
            F.col("p_id").alias("pr_p_id"), F.col("s_id").alias("pr_s_id"), F.col("day").alias("pr_date")
        )
        eventstores = daily.filter(F.col("campaign").isNotNull()).select(
            F.col("campaign").alias("es_e_id"), F.col("s_id").alias("es_s_id"), F.col("day").alias("es_date")
        )
        return sales, promotions, eventstores

    def products(self) -> DataFrame:
        number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
        return (
            self.raw("part")
            .select(number.alias("p_id"), F.col("p_brand").alias("p_name"))
            .distinct()
            .withColumn("p_group", F.concat(F.lit("GROUP_"), (F.col("p_id") % 5).cast("string")))
        )

    def stores(self) -> DataFrame:
        """Stores with a location taken from the balances of the customers of the region."""
        place = (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_regionkey").alias("r_regionkey"))
            .agg(
                F.round(F.max("c_acctbal") / 100, 4).alias("s_longitude"),
                F.round(F.min("c_acctbal") / 100, 4).alias("s_latitude"),
            )
        )
        return (
            self.raw("region")
            .join(place, "r_regionkey", "left")
            .select(
                F.col("r_regionkey").alias("s_id"),
                F.col("r_name").alias("s_name"),
                "s_longitude",
                "s_latitude",
            )
        )

    def workshops(self) -> DataFrame:
        group = (F.col("s_suppkey") % WORKSHOP_GROUPS).cast("int")
        return (
            self.raw("supplier")
            .groupBy(group.alias("w_id"))
            .agg(
                F.round(F.max("s_acctbal") / 100, 4).alias("w_longitude"),
                F.round(F.min("s_acctbal") / 100, 4).alias("w_latitude"),
            )
            .select(
                "w_id",
                F.concat(F.lit("WORKSHOP_"), F.col("w_id").cast("string")).alias("w_name"),
                (150 + 50 * F.col("w_id")).cast("int").alias("w_capacity"),
                "w_longitude",
                "w_latitude",
            )
        )

    def promotions(self, date_from: str | None = None, date_upto: str | None = None) -> DataFrame:
        return (
            self.sales(date_from, date_upto)
            .filter(F.col("max_disc") >= 0.09)
            .select(
                F.col("sa_p_id").alias("pr_p_id"),
                F.col("sa_s_id").alias("pr_s_id"),
                F.col("sa_date").alias("pr_date"),
            )
        )

    def eventstores(self, date_from: str | None = None, date_upto: str | None = None) -> DataFrame:
        """Campaign days: lines sold at the top discount and top tax; the line number names the
        event, so one store-day can hold several events."""
        return (
            self._lines(date_from, date_upto)
            .filter((F.col("l_discount") >= 0.095) & (F.col("l_tax") >= 0.075))
            .select(
                F.col("l_linenumber").alias("es_e_id"),
                F.col("s_id").alias("es_s_id"),
                F.col("day").alias("es_date"),
            )
            .distinct()
        )

    def transportlinks(self) -> DataFrame:
        p, s, w = F.col("p_id"), F.col("s_id"), F.col("w_id")
        return (
            self._lines()
            .select("p_id", "s_id", "w_id")
            .distinct()
            .select(
                p.alias("tl_p_id"),
                s.alias("tl_s_id"),
                w.alias("tl_w_id"),
                F.round(0.1 + ((p * 3 + s * 5 + w * 7) % 11) / 10.0, 2)
                .cast("double")
                .alias("tl_package_cost"),
                (5 + (p * 7 + s * 3 + w) % 16).cast("int").alias("tl_package_size"),
            )
        )

    def procurements(self) -> DataFrame:
        """One active window per product, store and month: first to last sale, end excluded."""
        return (
            self.sales()
            .groupBy(
                F.col("sa_p_id").alias("pc_p_id"),
                F.col("sa_s_id").alias("pc_s_id"),
                F.trunc("sa_date", "month").alias("pc_month"),
            )
            .agg(
                F.min("sa_date").alias("pc_active_from"),
                F.date_add(F.max("sa_date"), 1).alias("pc_active_upto"),
            )
            .drop("pc_month")
        )

    def demandpredictions(self) -> DataFrame:
        """Same-weekday-last-week forecast for every sold day."""
        return self.sales().select(
            F.col("sa_p_id").alias("dp_p_id"),
            F.col("sa_s_id").alias("dp_s_id"),
            F.date_add("sa_date", 7).alias("dp_date"),
            F.col("sa_units_sold").cast("int").alias("dp_mean"),
        )

    def stocks(self) -> DataFrame:
        return self.sales().select(
            F.col("sa_p_id").alias("sk_p_id"),
            F.col("sa_s_id").alias("sk_s_id"),
            F.col("sa_date").alias("sk_date"),
            (F.col("sa_units_sold") + 10).cast("int").alias("sk_units"),
        )

    def procurementplans(self) -> DataFrame:
        """Units shipped by each workshop per product, store and day."""
        return (
            self._lines()
            .groupBy(
                F.col("p_id").alias("pl_p_id"),
                F.col("s_id").alias("pl_s_id"),
                F.col("w_id").alias("pl_w_id"),
                F.col("day").alias("pl_date"),
            )
            .agg(F.sum("l_quantity").cast("int").alias("pl_expected_units"))
        )

    def demandfulfillments(self) -> DataFrame:
        """A stored fulfilment: at most 40 units a day are met, closing stock refills to 60."""
        units = F.col("sa_units_sold")
        met = F.least(units, F.lit(40)).cast("int")
        closing = F.greatest(F.lit(0), 60 - units).cast("int")
        return (
            self.sales()
            .select(
                F.col("sa_p_id").alias("df_p_id"),
                F.col("sa_s_id").alias("df_s_id"),
                F.col("sa_date").alias("df_date"),
                (met + closing).alias("df_initial_stocks"),
                closing.alias("df_closing_stocks"),
                met.alias("df_met_demand"),
                F.greatest(F.lit(0), units - 40).cast("int").alias("df_unmet_demand"),
            )
        )

    def events(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_linenumber").alias("e_id"))
            .agg(F.min("l_returnflag").alias("e_type"), F.max("l_linestatus").alias("e_locality"))
            .withColumn("e_name", F.concat(F.lit("EVENT_"), F.col("e_id").cast("string")))
            .select("e_id", "e_name", "e_type", "e_locality")
        )

    def nation_flows(self) -> DataFrame:
        """Shipped volume between customer nation and supplier nation."""
        return self._flows(None)

    def monthly_flows(self) -> DataFrame:
        """:meth:`nation_flows` per ship month; months are numbered ``year * 12 + month``."""
        return self._flows(F.col("l_shipdate"))

    def _flows(self, stamp) -> DataFrame:
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
        )
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customer = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")
        )
        supplier = self.raw("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")
        )
        keys = ["src", "dst"]
        if stamp is not None:
            month = (F.year(stamp) * 12 + F.month(stamp)).cast("int")
            lines = lines.withColumn("month_no", month)
            keys = ["month_no", *keys]
        return (
            lines.join(orders, "l_orderkey")
            .join(customer, "o_custkey")
            .join(supplier, "l_suppkey")
            .groupBy(*keys)
            .agg(
                F.count("*").alias("n_lines"),
                F.sum("l_linenumber").alias("line_sum"),
                F.sum("l_quantity").cast("long").alias("quantity"),
            )
        )
