"""Projections, filters, joins, aggregates, sorts, scalar functions, reshaping and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from restock.catalog.feature_queries import n1, n1_body, SNAP, SNAP_TABLES, H_NAMES
from restock.catalog.registry import AS_OF, SPLIT, TRAIN_FROM, calendar_sql, query, r6, sql
from restock.functions import dates, numeric
from restock.operators import features, relational, reshape
from restock.plans import reports

CAL = {"cal": calendar_sql()}


def rounded_view(inner: str, doubles: list[str]) -> str:
    return f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in doubles)}) from ({inner})"


# --- P: projections and filters ----------------------------------------------------------------


@query("P1_select_rename", sql("sales", "select sa_p_id dp_p_id, sa_s_id dp_s_id, sa_date dp_date from sales"))
def _(core):
    return core.sales().select("sa_p_id", "sa_s_id", "sa_date").withColumnsRenamed(
        {"sa_p_id": "dp_p_id", "sa_s_id": "dp_s_id", "sa_date": "dp_date"}
    )


@query(
    "P2_with_columns",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, sa_date, cast(sa_units_sold * 2 as bigint) twice,
 sa_units_sold > 30 large, cast(year(sa_date) as int) as "year" from sales""",
    ),
)
def _(core):
    return core.sales().select("sa_p_id", "sa_s_id", "sa_date", "sa_units_sold").withColumns(
        {
            "twice": F.col("sa_units_sold") * 2,
            "large": F.col("sa_units_sold") > 30,
            "year": F.year("sa_date"),
        }
    ).drop("sa_units_sold")


@query(
    "P3_select_by_type",
    sql(SNAP_TABLES, f"""select product_id, store_id, {", ".join(f"next_{h}d_event_id" for h in range(1, 8))},
 product_group from ({n1_body()})""", snap=SNAP),
)
def _(core):
    snap = n1(core)
    return snap.select(*relational.columns_of_type(snap, "integer", "string"))


@query(
    "P4_drop_columns_and_types",
    sql("sales", "select sa_p_id, sa_s_id, sa_units_sold from sales"),
)
def _(core):
    return relational.drop_types(core.sales().drop("max_disc"), "date")


@query(
    "P5_pop_target_columns",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, c_date, {", ".join(f"round({c}, 6) {c}" for c in H_NAMES)}
 from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    _, targets = relational.pop_columns(n1(core), H_NAMES, ["product_id", "store_id", "c_date"])
    return targets.withColumns({c: r6(F.col(c)) for c in H_NAMES})


@query(
    "P6_select_by_prefix",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, c_date, {", ".join(f"next_{h}d_event_id" for h in range(1, 8))},
 {", ".join(f"next_{h}d_is_on_promo" for h in range(1, 8))} from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    snap = n1(core)
    return snap.select("product_id", "store_id", "c_date", *relational.columns_with_prefix(snap, "next_"))


@query(
    "P7_prefix_all_names",
    sql(
        "demandfulfillments",
        """select df_p_id pcpl_p_id, df_s_id pcpl_s_id, df_date "pcpl_date", df_met_demand pcpl_met_demand
 from demandfulfillments""",
    ),
)
def _(core):
    df = core.demandfulfillments().select(
        F.col("df_p_id").alias("p_id"),
        F.col("df_s_id").alias("s_id"),
        F.col("df_date").alias("date"),
        F.col("df_met_demand").alias("met_demand"),
    )
    return relational.prefix_all(df, "pcpl_")


@query(
    "P8_filter_compound",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales
 where (sa_units_sold > 30 or max_disc >= 0.09) and not (sa_s_id = 2)""",
    ),
)
def _(core):
    big = (F.col("sa_units_sold") > 30) | (F.col("max_disc") >= 0.09)
    return core.sales().filter(big & ~(F.col("sa_s_id") == 2)).drop("max_disc")


ITEMS = [2, 4, 17, 21, 23]


@query(
    "P9_is_in_and_negation",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales
 where sa_p_id in (2, 4, 17, 21, 23) and sa_s_id not in (1, 3)""",
    ),
)
def _(core):
    kept = F.col("sa_p_id").isin(ITEMS) & ~F.col("sa_s_id").isin([1, 3])
    return core.sales().filter(kept).drop("max_disc")


@query(
    "P10_between_dates",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales
 where sa_date between date '1997-01-01' and date '1998-12-31'""",
    ),
)
def _(core):
    return core.sales("1997-01-01", "1998-12-31").drop("max_disc")


@query(
    "P11_null_tests",
    sql(
        SNAP_TABLES,
        """select sold_on c_date, product product_id, store store_id, event is not null has_event, event is null no_event,
 not (event is null) flagged from snap""",
        snap=SNAP,
    ),
)
def _(core):
    from restock.operators.snapshot import labelled_sales

    sales, promos, events = core.daily_tables()
    e = F.col("event_id")
    return labelled_sales(sales, events, promos, core.products()).select(
        "c_date",
        "product_id",
        "store_id",
        e.isNotNull().alias("has_event"),
        e.isNull().alias("no_event"),
        (~e.isNull()).alias("flagged"),
    )


@query(
    "P12_date_split",
    sql(
        "sales",
        f"""select 'train' part, cast(count(*) as bigint) n, cast(sum(sa_units_sold) as bigint) units,
 min(sa_date) first_day, max(sa_date) last_day from sales where sa_date < date '{SPLIT}'
 union all select 'valid', count(*), cast(sum(sa_units_sold) as bigint), min(sa_date), max(sa_date)
 from sales where sa_date >= date '{SPLIT}'""",
    ),
)
def _(core):
    train, valid = features.split_by_date(core.sales(), SPLIT, "sa_date")
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("part").agg(
        F.count("*").alias("n"),
        F.sum("sa_units_sold").alias("units"),
        F.min("sa_date").alias("first_day"),
        F.max("sa_date").alias("last_day"),
    )


@query(
    "P13_as_of_rows",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, round(log_units_sold, 6) log_units_sold, product_group
 from ({n1_body()}) where c_date = date '{AS_OF}'""",
        snap=SNAP,
    ),
)
def _(core):
    snap = n1(core).filter(F.col("c_date") == F.lit(AS_OF).cast("date"))
    return snap.select("product_id", "store_id", r6(F.col("log_units_sold")).alias("log_units_sold"), "product_group")


@query(
    "P14_skip_empty_batch",
    sql(
        "sales",
        """select '2000-08-15' batch, cast(count(*) as bigint) n, count(*) = 0 skipped from sales
 where sa_date = date '2000-08-15' union all
 select '1990-01-01', count(*), count(*) = 0 from sales where sa_date = date '1990-01-01'""",
    ),
)
def _(core):
    from functools import reduce

    from restock.operators.integrity import batch_or_none

    parts = []
    for day in ("2000-08-15", "1990-01-01"):
        rows = core.sales(day, day)
        batch = batch_or_none(rows)
        counted = rows.agg(F.count("*").alias("n")).select(
            F.lit(day).alias("batch"), "n", F.lit(batch is None).alias("skipped")
        )
        parts.append(counted)
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- J: joins ----------------------------------------------------------------------------------


@query(
    "J3_inner_name_lookup",
    sql(
        "sales products stores",
        """select p_name, s_name, sa_date, sa_units_sold from sales join products on sa_p_id = p_id
 join stores on sa_s_id = s_id""",
    ),
)
def _(core):
    return (
        core.sales()
        .join(core.products(), F.col("sa_p_id") == F.col("p_id"))
        .join(core.stores(), F.col("sa_s_id") == F.col("s_id"))
        .select("p_name", "s_name", "sa_date", "sa_units_sold")
    )


@query(
    "J4_inner_join_drops_unplanned_days",
    sql(
        "demandfulfillments procurementplans",
        """select df_p_id, df_s_id, df_date, df_met_demand, cast(u as bigint) expected_units
 from demandfulfillments join (select pl_p_id, pl_s_id, pl_date + 1 arrives, sum(pl_expected_units) u from procurementplans
 group by 1, 2, 3) on pl_p_id = df_p_id and pl_s_id = df_s_id and arrives = df_date""",
    ),
)
def _(core):
    # deliveries arrive the day after, so some days have none
    plans = core.procurementplans().withColumn("pl_date", F.date_add("pl_date", 1))
    plan = reports.daily_plan(plans).toDF("df_p_id", "df_s_id", "df_date", "expected_units")
    return core.demandfulfillments().join(plan, ["df_p_id", "df_s_id", "df_date"]).select(
        "df_p_id", "df_s_id", "df_date", "df_met_demand", "expected_units"
    )


def _named_sales(core):
    """A landing batch: names instead of ids."""
    return (
        core.sales()
        .join(core.products(), F.col("sa_p_id") == F.col("p_id"))
        .join(core.stores(), F.col("sa_s_id") == F.col("s_id"))
        .select("p_name", "s_name", "sa_date", "sa_units_sold")
    )


@query("J5_strict_name_map", sql("sales", "select sa_p_id p_name, sa_s_id s_name, sa_date, sa_units_sold from sales"))
def _(core):
    mapped = relational.strict_map(_named_sales(core), "p_name", core.products(), "p_name", "p_id")
    return relational.strict_map(mapped, "s_name", core.stores(), "s_name", "s_id")


@query(
    "J6_cross_join_calendar",
    sql(
        "products stores sales",
        """select p_id, s_id, c_date from products cross join stores
 cross join (select distinct sa_date c_date from sales)""",
    ),
)
def _(core):
    grid = relational.full_grid(core.stores().select("s_id"), core.products().select("p_id"))
    days = core.sales().select(F.col("sa_date").alias("c_date")).distinct()
    return relational.full_grid(grid, days)


@query(
    "J7_always_true_join",
    sql(
        "all_eventstores stores",
        "select es_e_id, es_date, s_name from (select distinct es_e_id, es_date from all_eventstores) join stores on 1 = 1",
    ),
)
def _(core):
    days = core.eventstores().select("es_e_id", "es_date").distinct()
    return relational.full_grid(core.stores().select("s_name"), days)


@query(
    "J8_equi_interval_join",
    sql(
        "sales procurements",
        """select sa_p_id, sa_s_id, sa_date, pc_active_from, pc_active_upto from sales left join procurements
 on pc_p_id = sa_p_id and pc_s_id = sa_s_id and pc_active_from <= sa_date - 3 and sa_date - 3 < pc_active_upto""",
    ),
)
def _(core):
    windows = core.procurements().select(
        F.col("pc_p_id").alias("sa_p_id"), F.col("pc_s_id").alias("sa_s_id"), "pc_active_from", "pc_active_upto"
    )
    asked = core.sales().select("sa_p_id", "sa_s_id", "sa_date", F.date_sub("sa_date", 3).alias("ask_date"))
    joined = relational.interval_join(
        asked, windows, ["sa_p_id", "sa_s_id"], "ask_date", "pc_active_from", "pc_active_upto"
    )
    return joined.drop("ask_date")


@query(
    "J9_theta_join_active_days",
    sql(
        "procurements sales",
        """select pc_p_id, pc_s_id, c_date from procurements join (select distinct sa_date c_date from sales)
 on pc_active_from <= c_date and c_date < pc_active_upto""",
    ),
)
def _(core):
    known = core.sales().select(F.col("sa_date").alias("c_date")).distinct()
    first, last = known.agg(F.min("c_date")).scalar(), known.agg(F.max("c_date")).scalar()
    days = relational.active_days(
        core.procurements(), "pc_active_from", "pc_active_upto", first, last, "c_date"
    )
    return days.join(known, "c_date", "left_semi").select("pc_p_id", "pc_s_id", "c_date")


@query(
    "J12_preaggregated_left_join",
    sql(
        "demandfulfillments procurementplans",
        """select df_p_id, df_s_id, df_date, df_initial_stocks, cast(u as bigint) expected_units
 from demandfulfillments left join (select pl_p_id, pl_s_id, pl_date + 1 arrives, sum(pl_expected_units) u from procurementplans
 group by 1, 2, 3) on pl_p_id = df_p_id and pl_s_id = df_s_id and arrives = df_date""",
    ),
)
def _(core):
    plans = core.procurementplans().withColumn("pl_date", F.date_add("pl_date", 1))
    plan = reports.daily_plan(plans).toDF("df_p_id", "df_s_id", "df_date", "expected_units")
    return core.demandfulfillments().join(plan, ["df_p_id", "df_s_id", "df_date"], "left").select(
        "df_p_id", "df_s_id", "df_date", "df_initial_stocks", "expected_units"
    )


@query(
    "J14_keyed_column_glue",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, c_date, round(log_units_sold, 6) log_units_sold,
 round(h1_log_units_sold, 6) h1_log_units_sold from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    snap = n1(core)
    key = ["product_id", "store_id", "c_date"]
    inputs, targets, _dates = features.input_target_dates(snap.withColumn("is_valid", F.lit(False)))
    return inputs.join(targets, key).select(
        *key, r6(F.col("log_units_sold")).alias("log_units_sold"), r6(F.col("h1_log_units_sold")).alias("h1_log_units_sold")
    )


# --- A: aggregates -----------------------------------------------------------------------------


@query(
    "A1_group_sum",
    sql(
        "procurementplans",
        """select pl_p_id p_id, pl_s_id s_id, pl_date c_date, cast(sum(pl_expected_units) as bigint) expected_units
 from procurementplans group by 1, 2, 3""",
    ),
)
def _(core):
    return reports.daily_plan(core.procurementplans())


@query(
    "A2_group_count_having",
    sql("sales", "select sa_s_id, sa_p_id, count(*) total_sales from sales group by 1, 2 having count(*) > 430"),
)
def _(core):
    return (
        core.sales().groupBy("sa_s_id", "sa_p_id").agg(F.count("*").alias("total_sales")).filter("total_sales > 430")
    )


@query(
    "A3_two_level_group",
    sql(
        "sales",
        """select sa_s_id, count(*) total_items, round(avg(n), 6) mean_days from (
 select sa_s_id, sa_p_id, count(*) n from sales group by 1, 2 having count(*) > 400) group by 1""",
    ),
)
def _(core):
    items = core.sales().groupBy("sa_s_id", "sa_p_id").agg(F.count("*").alias("n")).filter("n > 400")
    return items.groupBy("sa_s_id").agg(
        F.count("*").alias("total_items"), r6(F.avg("n")).alias("mean_days")
    )


@query(
    "A4_group_first",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, min_by(sa_units_sold, sa_date) first_units, min(sa_date) first_day
 from sales group by 1, 2""",
    ),
)
def _(core):
    return core.sales().groupBy("sa_p_id", "sa_s_id").agg(
        F.min_by("sa_units_sold", "sa_date").alias("first_units"), F.min("sa_date").alias("first_day")
    )


@query(
    "A5_pivot_sum",
    sql(
        "sales",
        "select sa_s_id store_id, "
        + ", ".join(f'cast(sum(case when sa_p_id = {i} then sa_units_sold end) as bigint) "{i}"' for i in range(1, 26))
        + " from sales group by 1",
    ),
)
def _(core):
    s = core.sales().withColumnRenamed("sa_s_id", "store_id")
    products = [r.p_id for r in core.products().select("p_id").distinct().orderBy("p_id").collect()]
    return relational.pivot_sum(s, "store_id", "sa_p_id", products, "sa_units_sold")


_LEVELS = """select {level} as "level", {p} p_id, {s} s_id, df_date c_date,
 cast(sum(df_met_demand) as bigint) met_demand, cast(sum(df_unmet_demand) as bigint) unmet_demand
 from demandfulfillments group by {by}"""


@query(
    "A6_sum_all_levels",
    sql(
        "demandfulfillments",
        " union all ".join(
            _LEVELS.format(level=f"'{level}'", p=p, s=s, by=by)
            for level, p, s, by in [
                ("total", "cast(null as int)", "cast(null as int)", "df_date"),
                ("product", "df_p_id", "cast(null as int)", "df_p_id, df_date"),
                ("store", "cast(null as int)", "df_s_id", "df_s_id, df_date"),
                ("product_store", "df_p_id", "df_s_id", "df_p_id, df_s_id, df_date"),
            ]
        ),
    ),
)
def _(core):
    return relational.sum_all_levels(_measures(core), "p_id", "s_id", ["met_demand", "unmet_demand", "orders"])


def _measures(core):
    return core.demandfulfillments().select(
        F.col("df_p_id").alias("p_id"),
        F.col("df_s_id").alias("s_id"),
        F.col("df_date").alias("c_date"),
        F.col("df_met_demand").alias("met_demand"),
        F.col("df_unmet_demand").alias("unmet_demand"),
    )


@query(
    "A6_sum_one_level",
    sql(
        "demandfulfillments",
        """select df_s_id s_id, df_date c_date, cast(sum(df_met_demand) as bigint) met_demand,
 cast(sum(df_unmet_demand) as bigint) unmet_demand from demandfulfillments group by 1, 2""",
    ),
)
def _(core):
    return relational.sum_by_level(_measures(core), ["s_id"], ["met_demand", "unmet_demand", "orders"])


@query(
    "A7_global_min_max_scaling",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, sa_date, (sa_units_sold - lo) / (hi - lo) scaled
 from sales cross join (select min(sa_units_sold) lo, max(sa_units_sold) hi from sales)""",
    ),
)
def _(core):
    s = core.sales()
    return s.select("sa_p_id", "sa_s_id", "sa_date", relational.min_max_scaled(s, "sa_units_sold").alias("scaled"))


@query("A8_distinct", sql("sales", "select distinct sa_p_id, sa_s_id from sales"))
def _(core):
    return core.sales().select("sa_p_id", "sa_s_id").distinct()


@query(
    "A9_null_counts",
    sql(
        SNAP_TABLES,
        "select "
        + ", ".join(f"count(*) - count({c}) {c}" for c in ["c_date", "product_id", "next_1d_event_id", "next_7d_event_id", *H_NAMES])
        + f" from ({n1_body()})",
        snap=SNAP,
    ),
)
def _(core):
    cols = ["c_date", "product_id", "next_1d_event_id", "next_7d_event_id", *H_NAMES]
    return relational.null_counts(n1(core).select(*cols))


def residuals(core):
    """Units sold minus the same-weekday-last-week forecast, where both exist."""
    f = core.demandpredictions().toDF("sa_p_id", "sa_s_id", "sa_date", "dp_mean")
    return core.sales().join(f, ["sa_p_id", "sa_s_id", "sa_date"]).select(
        "sa_p_id", "sa_s_id", "sa_date", (F.col("sa_units_sold") - F.col("dp_mean")).alias("residual")
    )


RESIDUAL_SQL = """select sa_p_id, sa_s_id, sa_date, sa_units_sold - dp_mean residual from sales
 join demandpredictions on dp_p_id = sa_p_id and dp_s_id = sa_s_id and dp_date = sa_date"""
DESCRIBE_SQL = sql(
    "sales demandpredictions",
    """select count(residual) as "count", count(*) - count(residual) null_count, round(avg(residual), 6) mean,
 round(stddev_samp(residual), 6) std, min(residual) as "min", round(quantile_cont(residual, 0.25), 6) q25,
 round(quantile_cont(residual, 0.5), 6) q50, round(quantile_cont(residual, 0.75), 6) q75, max(residual) as "max"
 from residuals""",
    residuals=RESIDUAL_SQL,
)


def _described(core):
    d = relational.describe_whole_units(residuals(core), "residual")
    return d.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


query("A10_describe", DESCRIBE_SQL)(_described)


@query(
    "A11_row_mean",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, c_date, round(list_avg([{", ".join(H_NAMES)}]), 6) mean_target
 from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    return n1(core).select(
        "product_id", "store_id", "c_date", r6(relational.row_mean(H_NAMES)).alias("mean_target")
    )


FULFILMENT_SQL = """select * from (with deliveries as (select pl_p_id, pl_s_id, pl_date, cast(sum(pl_expected_units) as bigint) units
 from procurementplans group by all)
 select f.df_date as "Date", (select min(p_name) from products where p_id = f.df_p_id) as "Product",
 (select min(s_name) from stores where s_id = f.df_s_id) as "Store", f.df_met_demand as "Fulfilled Sales",
 f.df_unmet_demand as "Unfulfilled Sales", d.units as "Units To Deliver", f.df_initial_stocks as "Initial Stocks",
 f.df_closing_stocks as "Closing Stocks" from deliveries d, demandfulfillments f
 where (d.pl_p_id, d.pl_s_id, d.pl_date) = (f.df_p_id, f.df_s_id, f.df_date))"""
REPORT_TABLES = "demandfulfillments procurementplans products stores"


def _fulfilment(core):
    return reports.fulfilment_table(
        core.demandfulfillments(), core.procurementplans(), core.products(), core.stores()
    )


@query(
    "A12_demand_totals",
    sql(
        REPORT_TABLES,
        """select "Product", "Store", cast(sum("Fulfilled Sales") as bigint) met_demand,
 cast(sum("Unfulfilled Sales") as bigint) unmet_demand from f group by 1, 2""",
        f=FULFILMENT_SQL,
    ),
)
def _(core):
    return reports.demand_totals(_fulfilment(core))


@query(
    "A13_workshop_load",
    sql(
        "procurementplans",
        """select pl_w_id, max(u) max_units, min(u) min_units from (select pl_w_id, pl_date,
 cast(sum(pl_expected_units) as bigint) u from procurementplans group by 1, 2) group by 1""",
    ),
)
def _(core):
    return reports.workshop_load(core.procurementplans())


@query(
    "A14_tuple_frequency",
    sql(
        "lines",
        "select p_id, s_id, w_id, count(*) n from lines group by 1, 2, 3",
    ),
)
def _(core):
    return core._lines().groupBy("p_id", "s_id", "w_id").agg(F.count("*").alias("n"))


# --- O, U: sorts, limits, union ----------------------------------------------------------------


@query("O1_multi_key_sort", sql("sales", "select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales order by 1, 2, 3"))
def _(core):
    return core.sales().drop("max_disc").orderBy("sa_p_id", "sa_s_id", "sa_date")


@query(
    "O2_sort_by_position",
    sql("transportlinks", "select tl_p_id, tl_s_id, tl_w_id, tl_package_size from transportlinks order by 1, 2, 3"),
)
def _(core):
    return core.transportlinks().drop("tl_package_cost").orderBy(1, 2, 3)


@query(
    "O3_top_series",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, cast(sum(sa_units_sold) as bigint) units from sales group by 1, 2
 order by units desc, sa_p_id, sa_s_id limit 10""",
    ),
)
def _(core):
    return (
        core.sales()
        .groupBy("sa_p_id", "sa_s_id")
        .agg(F.sum("sa_units_sold").alias("units"))
        .orderBy(F.desc("units"), "sa_p_id", "sa_s_id")
        .limit(10)
    )


@query(
    "U1_vertical_concat",
    sql(
        "stocks demandfulfillments",
        """select sk_p_id p_id, sk_s_id s_id, sk_date c_date, sk_units ending_inventory from stocks
 union all select df_p_id, df_s_id, df_date, df_closing_stocks from demandfulfillments""",
    ),
)
def _(core):
    names = ["p_id", "s_id", "c_date", "ending_inventory"]
    now = core.stocks().toDF(*names)
    later = core.demandfulfillments().select("df_p_id", "df_s_id", "df_date", "df_closing_stocks").toDF(*names)
    return now.unionByName(later)


# --- F: scalar functions -----------------------------------------------------------------------

SALES_KEY = ["sa_p_id", "sa_s_id", "sa_date"]


def scalar_query(key: str, select: str, build, tables: str = "sales"):
    @query(key, sql(tables, f"select sa_p_id, sa_s_id, sa_date, {select} from sales"))
    def _(core):
        return core.sales().select(*SALES_KEY, *[c.alias(n) for n, c in build().items()])


def U():
    return F.col("sa_units_sold")


def D():
    return F.col("sa_date")


scalar_query("F1_log1p", "round(ln(sa_units_sold + 1), 6) log_units", lambda: {"log_units": r6(numeric.log_units(U()))})
scalar_query(
    "F2_inverse_log",
    "cast(round(exp(ln(sa_units_sold + 1) * 0.9) - 1) as int) units",
    lambda: {"units": numeric.units_from_log(numeric.log_units(U()) * 0.9)},
)
scalar_query(
    "F3_coalesce",
    "coalesce(case when sa_units_sold > 30 then sa_units_sold end, 0) large_units",
    lambda: {"large_units": F.coalesce(F.when(U() > 30, U()), F.lit(0))},
)
scalar_query("F4_iso_weekday", "cast(isodow(sa_date) as int) weekday", lambda: {"weekday": dates.iso_weekday(D())})
scalar_query(
    "F5_calendar_parts",
    """cast(day(sa_date) as int) dayofmonth, cast(dayofyear(sa_date) as int) dayofyear,
 cast(month(sa_date) as int) as "month", cast(year(sa_date) as int) as "year" """,
    lambda: {k: dates.calendar_columns(D())[k] for k in ("dayofmonth", "dayofyear", "month", "year")},
)
scalar_query("F6_iso_week", "cast(weekofyear(sa_date) as int) iso_week", lambda: {"iso_week": F.weekofyear(D())})
scalar_query(
    "F7_date_plus_days",
    "sa_date - 1 day_before, sa_date + 7 week_after, sa_date + cast(sa_units_sold % 5 as int) shifted",
    lambda: {
        "day_before": dates.days_ago(D(), 1),
        "week_after": dates.days_ahead(D(), 7),
        "shifted": dates.days_ahead(D(), (U() % 5).cast("int")),
    },
)
scalar_query(
    "F8_calendar_offset",
    "cast(sa_date + interval 1 year as date) year_after, cast(sa_date + interval 1 year as date) - 3 lookup_day",
    lambda: {
        "year_after": dates.year_ahead(D()),
        "lookup_day": dates.days_ago(dates.year_ahead(D()), 3),
    },
)
scalar_query(
    "F9_interval_arithmetic",
    "cast(sa_date - interval 21 day as date) three_weeks_ago",
    lambda: {"three_weeks_ago": (D() - F.expr("interval 21 days")).cast("date")},
)
scalar_query(
    "F10_parse_date",
    "sa_date parsed_ymd, cast(strptime(strftime(sa_date, '%Y-%d-%m'), '%Y-%d-%m') as date) parsed_ydm",
    lambda: {
        "parsed_ymd": dates.parse_day(D().cast("string")),
        "parsed_ydm": dates.parse_day(F.date_format(D(), "yyyy-dd-MM"), "ydm"),
    },
)
scalar_query(
    "F11_casts",
    """cast(sa_date as varchar) day_text, cast(sa_units_sold > 30 as int) large_flag,
 cast(sa_units_sold as varchar) units_text, true as truth""",
    lambda: {
        "day_text": D().cast("string"),
        "large_flag": (U() > 30).cast("byte").cast("int"),
        "units_text": U().cast("string"),
        "truth": F.lit("True").cast("boolean"),
    },
)
scalar_query(
    "F15_abs_div_round",
    """abs(sa_units_sold - 30) distance, cast(sa_units_sold // 25 as bigint) packages,
 round(sa_units_sold / 7, 2) weekly""",
    lambda: {
        "distance": F.abs(U() - 30),
        "packages": F.expr("sa_units_sold div 25"),
        "weekly": F.round(U() / 7, 2),
    },
)
scalar_query(
    "F19_over_and_understock",
    "greatest(0, sa_units_sold - 80) overstock, greatest(0, 40 - sa_units_sold) understock",
    lambda: {
        "overstock": numeric.excess_over(U(), 80),
        "understock": numeric.shortfall_under(U(), 40),
    },
)
scalar_query(
    "F21_period_label",
    "strftime(date '2024-12-01' + cast(sa_units_sold as int), '%Y-%m-%d') start_label",
    lambda: {"start_label": dates.day_label("2024-12-01", U())},
)


@query(
    "F12_strip_literal",
    "select p_partkey, regexp_replace(p_name, 'red ', '') p_name from part",
)
def _(core):
    return core.raw("part").select("p_partkey", numeric.strip_first(F.col("p_name"), "red ").alias("p_name"))


@query(
    "F13_text_flag",
    "select o_orderkey, o_orderstatus is not null and o_orderstatus = 'F' finished from orders",
)
def _(core):
    text = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "False")
    return core.raw("orders").select("o_orderkey", numeric.flag_from_text(text).alias("finished"))


SEGMENTS = {"O": "open", "F": "finished", "P": "pending"}


@query(
    "F14_literal_mapping",
    """select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'finished'
 when 'P' then 'pending' end status from orders""",
)
def _(core):
    return core.raw("orders").select(
        "o_orderkey", relational.map_literals(F.col("o_orderstatus"), SEGMENTS).alias("status")
    )


LINK_PLACE_SQL = """select tl_p_id, tl_s_id, tl_w_id,
 abs(w_longitude - s_longitude) + abs(w_latitude - s_latitude) dist
 from transportlinks join stores on s_id = tl_s_id join workshops on w_id = tl_w_id"""


def _link_distance(core):
    dist = numeric.manhattan(
        F.col("w_longitude"), F.col("w_latitude"), F.col("s_longitude"), F.col("s_latitude")
    )
    return (
        core.transportlinks()
        .join(core.stores(), F.col("s_id") == F.col("tl_s_id"))
        .join(core.workshops(), F.col("w_id") == F.col("tl_w_id"))
        .select("tl_p_id", "tl_s_id", "tl_w_id", dist.alias("dist"))
    )


@query(
    "F16_manhattan_distance",
    sql("transportlinks stores workshops", "select tl_p_id, tl_s_id, tl_w_id, round(dist, 6) dist from d", d=LINK_PLACE_SQL),
)
def _(core):
    return _link_distance(core).withColumn("dist", r6(F.col("dist")))


@query(
    "F17_min_max_cost",
    sql(
        "transportlinks stores workshops",
        """select tl_p_id, tl_s_id, tl_w_id, round(0.1 + (dist - lo) / (hi - lo), 2) package_cost
 from d cross join (select min(dist) lo, max(dist) hi from d)""",
        d=LINK_PLACE_SQL,
    ),
)
def _(core):
    d = _link_distance(core)
    cost = F.round(relational.min_max_scaled(d, "dist", 0.1), 2)
    return d.select("tl_p_id", "tl_s_id", "tl_w_id", cost.alias("package_cost"))


@query(
    "F18_fill_null_zero",
    sql(
        SNAP_TABLES,
        f"""select product_id, store_id, c_date, {", ".join(f"round(coalesce({c}, 0), 6) {c}" for c in H_NAMES)}
 from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    filled = n1(core).select("product_id", "store_id", "c_date", *H_NAMES).fillna(0, subset=H_NAMES)
    return filled.withColumns({c: r6(F.col(c)) for c in H_NAMES})


@query(
    "F20_typed_parameters",
    """select o_orderkey, o_orderpriority, try_cast(regexp_extract(cast(o_totalprice as varchar), '^([0-9]+)$', 1) as bigint) as_int,
 case when contains(cast(o_totalprice as varchar), '.') then o_totalprice end as_float,
 cast(null as varchar) as_text from orders""",
)
def _(core):
    from restock.operators.forecast import typed_parameters

    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    short = F.regexp_replace(text, r"0$", "")
    return typed_parameters(
        core.raw("orders").select("o_orderkey", "o_orderpriority", short.alias("value")), "value"
    ).drop("value")


# --- R: reshaping ------------------------------------------------------------------------------


@query(
    "R1_wide_to_long",
    sql(
        SNAP_TABLES,
        " union all ".join(
            f"select product_id dp_p_id, store_id dp_s_id, c_date, c_date + {h} dp_date, cast(round(exp(h{h}_log_units_sold) - 1) as int) dp_mean from n1"
            for h in range(1, 8)
        ),
        snap=SNAP,
        n1=n1_body(),
    ),
)
def _(core):
    snap = n1(core)
    whole = {c: numeric.units_from_log(F.col(c)) for c in H_NAMES}
    days = F.array(*[F.date_add("c_date", h) for h in range(1, 8)])
    long = reshape.wide_to_long(
        snap.withColumns(whole), ["product_id", "store_id", "c_date"], H_NAMES, days, "dp_date", "dp_mean"
    )
    return long.withColumnsRenamed({"product_id": "dp_p_id", "store_id": "dp_s_id"})


@query(
    "R2_explode_literal_list",
    sql("sales", "select sa_p_id, sa_s_id, sa_date, h horizon from sales cross join (select unnest([1, 3, 7]) h)"),
)
def _(core):
    return reshape.explode_list(core.sales().select(*SALES_KEY), "horizon", [1, 3, 7])


@query(
    "R3_double_explode",
    sql(
        "workshops",
        """select w_name, p_group, s_no from workshops cross join (select unnest(['A', 'B']) p_group)
 cross join (select unnest([0, 1, 2, 3, 4]) s_no) join supplier on s_suppkey % 6 = w_id""",
    ),
)
def _(core):
    group = (F.col("s_suppkey") % 6).cast("int")
    rows = core.raw("supplier").select(group.alias("w_id")).join(core.workshops(), "w_id").select("w_name")
    return reshape.explode_list(reshape.explode_list(rows, "p_group", ["A", "B"]), "s_no", list(range(5)))


@query(
    "R5_date_spine",
    sql(
        "sales",
        """select sa_p_id, sa_s_id, cast(d as date) c_date, cast(row_number() over (partition by sa_p_id, sa_s_id order by d) as int) c_rank
 from (select sa_p_id, sa_s_id, unnest(generate_series(min(sa_date), max(sa_date), interval 1 day)) d from sales group by 1, 2)""",
    ),
)
def _(core):
    spans = core.sales().groupBy("sa_p_id", "sa_s_id").agg(F.min("sa_date").alias("a"), F.max("sa_date").alias("b"))
    return reshape.date_spine(spans, F.col("a"), F.col("b")).drop("a", "b")


@query(
    "W11_calendar_rank",
    sql(
        "sales",
        """select c_date, cast(row_number() over (order by c_date) as int) c_rank from (select cast(unnest(generate_series(
 min(sa_date), max(sa_date), interval 1 day)) as date) c_date from sales)""",
    ),
)
def _(core):
    span = core.sales().agg(F.min("sa_date").alias("a"), F.max("sa_date").alias("b"))
    return reshape.date_spine(span, F.col("a"), F.col("b")).drop("a", "b")


# --- N: reports --------------------------------------------------------------------------------


@query(
    "N2_planning_calendar",
    sql("sales", "select sa_p_id, sa_s_id, c_date, c_rank from (select distinct sa_p_id, sa_s_id from sales) cross join cal", **CAL),
)
def _(core):
    calendar = reshape.planning_calendar(core.spark, AS_OF)
    return relational.full_grid(calendar, core.sales().select("sa_p_id", "sa_s_id").distinct())


N3_TABLES = "products stores demandpredictions procurements"
N3_SQL = """select cell.p_id, cell.s_id, cell.c_rank,
 (select max(d.dp_mean) from demandpredictions d
  where (d.dp_p_id, d.dp_s_id, d.dp_date) = (cell.p_id, cell.s_id, cell.c_date)) pred_units_sold,
 exists (select 1 from procurements w where w.pc_p_id = cell.p_id and w.pc_s_id = cell.s_id
  and cell.c_date >= w.pc_active_from and cell.c_date < w.pc_active_upto) needs_order
 from (select p_id, s_id, c_rank, c_date from products, stores, cal) cell"""


def needs(core, date_from=AS_OF, window=7):
    return reports.procurement_needs(
        core.products(), core.stores(), core.demandpredictions(), core.procurements(), date_from, window
    )


query("N3_procurement_needs", sql(N3_TABLES, N3_SQL, **CAL))(needs)


@query(
    "N4_current_stocks",
    sql("stocks", f"select sk_p_id p_id, sk_s_id s_id, 0 c_rank, sk_units ending_inventory from stocks where sk_date = date '{AS_OF}'"),
)
def _(core):
    return reports.current_stocks(core.stocks(), AS_OF)


@query(
    "N5_links_by_day",
    sql(
        "transportlinks",
        """select tl_p_id p_id, tl_s_id s_id, tl_w_id w_id, c_rank, tl_package_cost package_cost,
 tl_package_size package_size from transportlinks cross join cal""",
        **CAL,
    ),
)
def _(core):
    return reports.links_by_day(core.transportlinks(), AS_OF)


@query(
    "N6_capacity_by_day",
    sql("workshops", "select w_id, c_rank, w_capacity capacity from workshops cross join cal", **CAL),
)
def _(core):
    return reports.capacity_by_day(core.workshops(), AS_OF)


# facts and plans as one list of signed rows, summed per cell
EVOLUTION_SQL = f"""select (select min(p_name) from products where p_id = prod) p_name,
 (select min(s_name) from stores where s_id = shop) s_name, "on" c_date, cast(sum(stock) - sum(coming) as bigint) initial_stocks,
 cast(sum(closing) as int) closing_stocks, cast(sum(met) as int) met_demand, cast(sum(unmet) as int) unmet_demand,
 cast(sum(coming) as bigint) expected_units from (
 select df_p_id prod, df_s_id shop, df_date "on", 1 facts, df_initial_stocks stock, df_closing_stocks closing, df_met_demand met,
 df_unmet_demand unmet, 0 coming from demandfulfillments
 union all select pl_p_id, pl_s_id, pl_date, 0, 0, 0, 0, 0, pl_expected_units from procurementplans)
 where "on" > date '{AS_OF}' group by prod, shop, "on" having sum(facts) > 0"""
RECENT_SQL = f"""select sa_date c_date, (select min(p_name) from products where p_id = sa_p_id) p_name,
 (select min(s_name) from stores where s_id = sa_s_id) s_name, sa_units_sold units_sold, 10 + sa_units_sold units
 from sales where date_diff('day', sa_date, date '{AS_OF}') between 0 and 21"""


def _evolution(core):
    return reports.demand_evolution(
        core.demandfulfillments(), core.procurementplans(), core.products(), core.stores(), AS_OF
    )


def _recent(core):
    return reports.recent_sales(core.sales(), core.products(), core.stores(), AS_OF, 21)


query("N7_demand_evolution", sql(REPORT_TABLES, EVOLUTION_SQL))(_evolution)


@query(
    "N8_locations",
    sql(
        "stores workshops",
        """select s_name as "name", s_longitude longitude, s_latitude latitude, cast(null as int) capacity from stores
 union all select w_name, w_longitude, w_latitude, w_capacity from workshops""",
    ),
)
def _(core):
    stores = reports.store_locations(core.stores()).toDF("name", "longitude", "latitude")
    makers = reports.workshop_locations(core.workshops()).toDF("name", "longitude", "latitude", "capacity")
    return stores.withColumn("capacity", F.lit(None).cast("int")).unionByName(makers)


query("N9_recent_sales", sql("sales products stores", RECENT_SQL))(_recent)
query("N10_fulfilment_table", sql(REPORT_TABLES, FULFILMENT_SQL))(_fulfilment)


@query(
    "N11_shipments",
    sql(
        "procurementplans products stores workshops",
        """select pl_date as "Date", p_name as "Product", s_name as "Store", w_name as "Factory",
 pl_expected_units as "Units", 'To Order' as "Status" from procurementplans left join products on p_id = pl_p_id
 left join stores on s_id = pl_s_id left join workshops on w_id = pl_w_id""",
    ),
)
def _(core):
    return reports.shipments(core.procurementplans(), core.products(), core.stores(), core.workshops())


@query(
    "N12_sorted_names",
    sql("products stores", """select 'product' kind, p_name as "name" from products union all select 'store', s_name from stores"""),
)
def _(core):
    products = reports.sorted_names(core.products(), "p_name").select(F.lit("product").alias("kind"), F.col("p_name").alias("name"))
    stores = reports.sorted_names(core.stores(), "s_name").select(F.lit("store").alias("kind"), F.col("s_name").alias("name"))
    return products.unionByName(stores).orderBy("kind", "name")


@query(
    "N13_stocks_with_names",
    sql(
        "stocks products stores",
        """select p_name, s_name, sk_date, sk_units from stocks left join products on p_id = sk_p_id
 left join stores on s_id = sk_s_id""",
    ),
)
def _(core):
    return reports.stocks_with_names(core.stocks(), core.products(), core.stores())


@query(
    "N14_balance_table",
    sql(
        REPORT_TABLES + " sales",
        """select p_name, s_name, c_date, measure, units from (
 select p_name, s_name, c_date, 'inventory' measure, cast(units as bigint) units from recent
 where (p_name, s_name) in (select p_name, s_name from evo)
 union all select p_name, s_name, c_date, 'sales', -units_sold from recent
 where (p_name, s_name) in (select p_name, s_name from evo)
 union all select p_name, s_name, c_date, 'projected_inventory', initial_stocks from evo
 union all select p_name, s_name, c_date, 'projected_deliveries', expected_units from evo
 union all select p_name, s_name, c_date, 'projected_met', -met_demand from evo
 union all select p_name, s_name, c_date, 'projected_unmet', -unmet_demand from evo)""",
        evo=EVOLUTION_SQL,
        recent=RECENT_SQL,
    ),
)
def _(core):
    return reports.balance_table(_evolution(core), _recent(core))


@query("N15_name_to_id", sql("products", "select p_name, p_id from products"))
def _(core):
    return reports.name_to_id(core.products(), "p_name", "p_id")
