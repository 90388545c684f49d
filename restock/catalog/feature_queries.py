"""Snapshot and feature queries: J2, W1–W19, F4–F9, N1, N16, P12, P5, P13."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from restock.catalog.registry import AS_OF, SPLIT, TRAIN_FROM, query, r6, sql
from restock.functions import dates, numeric
from restock.operators import features, snapshot
from restock.operators.features import WINDOWS
from restock.operators.frames import value_in_days

KEY = ["product_id", "store_id", "c_date"]
H = range(1, 8)

# --- SQL building blocks ---------------------------------------------------------------------

# facts of a sold day, looked up one by one
SNAP = """select sa_p_id product, sa_s_id store, sa_date sold_on, ln(1 + sa_units_sold) logged,
 (select min(p_group) from products where p_id = sa_p_id) grp,
 (select min(es_e_id) from eventstores where es_s_id = sa_s_id and es_date = sa_date) event,
 exists (select 1 from promotions where (pr_p_id, pr_s_id, pr_date) = (sa_p_id, sa_s_id, sa_date)) promoted from sales"""


def n1_body() -> str:
    """Every fact is seen from the 0 to 7 days before it; a day's row gathers what it sees."""
    at = lambda h, what: f"max({what}) filter (ahead = {h})"
    return f"""select seen_on c_date, product product_id, store store_id, {at(0, "logged")} log_units_sold,
 {at(0, "grp")} product_group, {", ".join(f"{at(h, 'event')} next_{h}d_event_id" for h in H)},
 {", ".join(f"coalesce(bool_or(promoted) filter (ahead = {h}), false) next_{h}d_is_on_promo" for h in H)},
 {", ".join(f"{at(h, 'logged')} h{h}_log_units_sold" for h in H)}
 from (select *, sold_on - cast(ahead as int) seen_on from snap, range(8) steps(ahead))
 group by product, store, seen_on
 having bool_or(ahead = 0) and seen_on between date '{TRAIN_FROM}' and date '{AS_OF}'"""


SERIES_SQL = "select sa_p_id product_id, sa_s_id store_id, sa_date c_date, ln(sa_units_sold + 1) x from sales"
SNAP_TABLES = "sales eventstores promotions products"
H_NAMES = [f"h{h}_log_units_sold" for h in H]


def rolling_sql(kinds: str, windows=WINDOWS, source: str = "series", extra: str = "") -> str:
    """Select list of rolling statistics written with DuckDB interval frames."""
    out = []
    for n in windows:
        w = (
            f"over (partition by product_id, store_id{extra} order by c_date"
            f" range between interval {n - 1} day preceding and current row)"
        )
        tag = f"{n}d_log_units_sold"
        forms = {
            "mean": f"round(avg(x) {w}, 6) mean_{tag}",
            "median": f"round(median(x) {w}, 6) median_{tag}",
            "std": f"round(stddev_samp(x) {w}, 6) std_{tag}",
            "min": f"round(min(x) {w}, 6) min_{tag}",
            "max": f"round(max(x) {w}, 6) max_{tag}",
            "diff": f"""round(case when count(x) {w} > 1 then
 (x - first_value(x) {w}) / (count(x) {w} - 1) end, 6) + 0.0 diff_mean_{tag}""",
            "ratio": f"round(max(x) {w} / nullif(avg(x) {w}, 0), 6) max_mean_ratio_{tag}",
        }
        out += [forms[k] for k in kinds.split()]
    return ", ".join(out)


def series(core):
    return core.sales().select(
        F.col("sa_p_id").alias("product_id"),
        F.col("sa_s_id").alias("store_id"),
        F.col("sa_date").alias("c_date"),
        numeric.log_units(F.col("sa_units_sold")).alias("log_units_sold"),
    )


def rounded(df):
    """Round every double column for comparison."""
    return df.select(
        *[r6(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else f.name
          for f in df.schema]
    )


def _rolling(kinds: tuple[str, ...]):
    def run(core):
        columns = features.rolling_columns("log_units_sold")
        keep = {k: v for k, v in columns.items() if k.startswith(kinds)}
        return rounded(series(core).select(*KEY, *[c.alias(n) for n, c in keep.items()]))

    return run


for _key, _prefix, _kind in [
    ("W1_rolling_mean", ("mean_",), "mean"),
    ("W2_rolling_median", ("median_",), "median"),
    ("W3_rolling_std", ("std_",), "std"),
    ("W4_rolling_min_max", ("min_", "max_2", "max_3", "max_7", "max_1"), "min max"),
    ("W5_rolling_diff_mean", ("diff_mean_",), "diff"),
    ("W6_max_mean_ratio", ("max_mean_ratio_",), "ratio"),
    ("J11_all_windows_on_row", ("m", "s", "d"), "mean median std min max diff ratio"),
]:
    query(
        _key,
        sql("sales", f"select product_id, store_id, c_date, {rolling_sql(_kind)} from series",
            series=SERIES_SQL),
    )(_rolling(_prefix))


# --- snapshot ----------------------------------------------------------------------------------


def n1(core, date_from=TRAIN_FROM, date_upto=AS_OF):
    # the rows look seven days ahead
    sales, promotions, eventstores = core.daily_tables(date_from, date_upto, ahead=len(H))
    return snapshot.training_snapshot(
        sales, eventstores, promotions, core.products(), date_from, date_upto
    )


N1_SQL = sql(
    SNAP_TABLES,
    f"""select * replace (round(log_units_sold, 6) as log_units_sold,
 {", ".join(f"round({c}, 6) as {c}" for c in H_NAMES)}) from ({n1_body()})""",
    snap=SNAP,
)


@query("N1_training_snapshot", N1_SQL)
def _(core):
    return rounded(n1(core))


@query(
    "J1_left_join_sales_dimensions",
    sql(
        SNAP_TABLES,
        """select sold_on c_date, product product_id, store store_id, round(logged, 6) log_units_sold,
 grp product_group, event event_id, promoted is_on_promo from snap""",
        snap=SNAP,
    ),
)
def _(core):
    return rounded(
        snapshot.labelled_sales(
            core.sales(), core.eventstores(), core.promotions(), core.products()
        )
    )


@query(
    "J2_shifted_self_join",
    sql(
        "sales",
        f"""select a.*, {", ".join(f"b{h}.units_sold units_in_{h}d" for h in H)} from s a
 {" ".join(f"left join s b{h} on b{h}.product_id = a.product_id and b{h}.store_id = a.store_id and b{h}.c_date = a.c_date + {h}" for h in H)}""",
        s="select sa_p_id product_id, sa_s_id store_id, sa_date c_date, sa_units_sold units_sold from sales",
    ),
)
def _(core):
    s = units(core)
    return s.select(
        "*", *[value_in_days("units_sold", h).alias(f"units_in_{h}d") for h in H]
    )


def units(core):
    return core.sales().select(
        F.col("sa_p_id").alias("product_id"),
        F.col("sa_s_id").alias("store_id"),
        F.col("sa_date").alias("c_date"),
        F.col("sa_units_sold").alias("units_sold"),
    )


@query(
    "W19_horizon_targets",
    sql(
        "sales",
        f"""select a.product_id, a.store_id, a.c_date, {", ".join(f"round(b{h}.x, 6) h{h}_log_units_sold" for h in H)}
 from series a {" ".join(f"left join series b{h} on b{h}.product_id = a.product_id and b{h}.store_id = a.store_id and b{h}.c_date = a.c_date + {h}" for h in H)}""",
        series=SERIES_SQL,
    ),
)
def _(core):
    s = series(core)
    return rounded(
        s.select(*KEY, *[value_in_days("log_units_sold", h).alias(f"h{h}_log_units_sold") for h in H])
    )


LAGS = (1, 3, 7, 14)


@query(
    "W18_lagged_values",
    sql(
        "sales",
        f"""select a.product_id, a.store_id, a.c_date, {", ".join(f"round(b{n}.x, 6) lag_{n}d_log_units_sold" for n in LAGS)}
 from series a {" ".join(f"left join series b{n} on b{n}.product_id = a.product_id and b{n}.store_id = a.store_id and b{n}.c_date = a.c_date - {n}" for n in LAGS)}""",
        series=SERIES_SQL,
    ),
)
def _(core):
    return rounded(
        series(core).select(
            *KEY,
            *[value_in_days("log_units_sold", -n).alias(f"lag_{n}d_log_units_sold") for n in LAGS],
        )
    )


# --- exponentially weighted means ------------------------------------------------------------

EWM_WINDOWS = (3, 7, 28)


def _ewm_join(n: int) -> str:
    return f"""select a.product_id, a.store_id, a.c_date,
 sum(b.x * pow(0.1, r)) / sum(pow(0.1, r)) v from (
 select a.product_id, a.store_id, a.c_date, b.x,
 row_number() over (partition by a.product_id, a.store_id, a.c_date order by b.c_date desc) - 1 r
 from series a join series b on a.product_id = b.product_id and a.store_id = b.store_id
 and b.c_date <= a.c_date and b.c_date > a.c_date - {n}) as b, lateral (select b.product_id, b.store_id, b.c_date) a
 group by 1, 2, 3"""


@query(
    "W7_rolling_ewm",
    sql(
        "sales",
        f"""select a.product_id, a.store_id, a.c_date,
 {", ".join(f"round(e{n}.v, 6) ewm_{n}d_log_units_sold" for n in EWM_WINDOWS)} from series a
 {" ".join(f"join e{n} on e{n}.product_id = a.product_id and e{n}.store_id = a.store_id and e{n}.c_date = a.c_date" for n in EWM_WINDOWS)}""",
        series=SERIES_SQL,
        **{f"e{n}": _ewm_join(n) for n in EWM_WINDOWS},
    ),
)
def _(core):
    return rounded(
        series(core).select(
            *KEY,
            *[features.rolling_ewm("log_units_sold", n).alias(f"ewm_{n}d_log_units_sold") for n in EWM_WINDOWS],
        )
    )


YEARLY_SQL = """select product_id, store_id, c_date, sum(x * pow(0.1, r)) / sum(pow(0.1, r)) v from (
 select a.product_id, a.store_id, a.c_date, b.x,
 row_number() over (partition by a.product_id, a.store_id, a.c_date order by b.c_date desc) - 1 r
 from series a join series b on a.product_id = b.product_id and a.store_id = b.store_id
 and dayofyear(a.c_date) = dayofyear(b.c_date) and b.c_date <= a.c_date
 and b.c_date > a.c_date - interval 3 year) group by 1, 2, 3"""


@query(
    "W8_yearly_ewm",
    sql(
        "sales",
        "select product_id, store_id, c_date, round(v, 6) ewm_3y_log_units_sold from yearly",
        series=SERIES_SQL,
        yearly=YEARLY_SQL,
    ),
)
def _(core):
    return rounded(
        series(core).select(*KEY, features.yearly_ewm("log_units_sold").alias("ewm_3y_log_units_sold"))
    )


def seasonal_joins(alias: str) -> str:
    return " ".join(
        f"""left join yearly y{h} on y{h}.product_id = {alias}.product_id and y{h}.store_id = {alias}.store_id
 and cast(y{h}.c_date + interval 1 year as date) - {h} = {alias}.c_date
 and not (month(y{h}.c_date) = 2 and day(y{h}.c_date) = 29)"""
        for h in H
    )


@query(
    "W9_seasonal_lookup",
    sql(
        "sales",
        f"""select a.product_id, a.store_id, a.c_date,
 {", ".join(f"round(y{h}.v, 6) h{h}_ewm_3y_log_units_sold" for h in H)} from series a {seasonal_joins("a")}""",
        series=SERIES_SQL,
        yearly=YEARLY_SQL,
    ),
)
def _(core):
    s = series(core).withColumn("ewm_3y", features.yearly_ewm("log_units_sold"))
    return rounded(
        s.select(*KEY, *[features.seasonal_lookup("ewm_3y", h).alias(f"h{h}_ewm_3y_log_units_sold") for h in H])
    )


@query(
    "J10_join_on_different_names",
    sql(
        "sales",
        """select a.product_id, a.store_id, a.c_date, round(a.x, 6) log_units_sold,
 round(b.x, 6) last_year_log_units_sold from series a left join series b on b.product_id = a.product_id
 and b.store_id = a.store_id and cast(b.c_date + interval 1 year as date) = a.c_date
 and not (month(b.c_date) = 2 and day(b.c_date) = 29)""",
        series=SERIES_SQL,
    ),
)
def _(core):
    s = series(core)
    shifted = s.filter(~dates.is_leap_day(F.col("c_date"))).select(
        F.col("product_id").alias("pid"),
        F.col("store_id").alias("sid"),
        dates.year_ahead(F.col("c_date")).alias("next_year"),
        F.col("log_units_sold").alias("last_year_log_units_sold"),
    )
    on = (
        (F.col("product_id") == F.col("pid"))
        & (F.col("store_id") == F.col("sid"))
        & (F.col("c_date") == F.col("next_year"))
    )
    return rounded(
        s.join(shifted, on, "left").select(*KEY, "log_units_sold", "last_year_log_units_sold")
    )


# --- fill, list and row windows ----------------------------------------------------------------


@query(
    "W10_forward_fill",
    sql(
        SNAP_TABLES,
        f"""select c_date, product_id, store_id, {", ".join(
            f"round(last_value({c} ignore nulls) over (partition by product_id, store_id order by c_date rows between unbounded preceding and current row), 6) {c}"
            for c in H_NAMES)} from ({n1_body()})""",
        snap=SNAP,
    ),
)
def _(core):
    return rounded(features.forward_fill(n1(core), H_NAMES).select(*KEY, *H_NAMES))


@query(
    "R4_fill_without_list_round_trip",
    sql(
        "sales",
        """select product_id, store_id, c_date, last_value(u ignore nulls) over (partition by
 product_id, store_id order by c_date rows between unbounded preceding and current row) last_large_order
 from (select sa_p_id product_id, sa_s_id store_id, sa_date c_date,
 case when sa_units_sold > 40 then sa_units_sold end u from sales)""",
    ),
)
def _(core):
    s = units(core).withColumn("last_large_order", F.when(F.col("units_sold") > 40, F.col("units_sold")))
    return features.forward_fill(s, ["last_large_order"]).drop("units_sold")


@query(
    "W12_starting_inventory_from_stock",
    sql(
        "demandfulfillments stocks",
        f"""select df_p_id, df_s_id, df_date, lag(closing) over (partition by df_p_id, df_s_id order by df_date) starting_inventory, df_closing_stocks
 from (select df_p_id, df_s_id, df_date, df_closing_stocks, df_closing_stocks closing from demandfulfillments where df_date > date '{AS_OF}'
 union all select sk_p_id, sk_s_id, sk_date, null, sk_units from stocks where sk_date = date '{AS_OF}')
 qualify df_date > date '{AS_OF}'""",
    ),
)
def _(core):
    """The plan's first day starts from the current stock, later days from the closing stock before."""
    later = core.demandfulfillments().filter(F.col("df_date") > F.lit(AS_OF).cast("date")).select(
        "df_p_id", "df_s_id", "df_date", "df_closing_stocks", F.col("df_closing_stocks").alias("closing")
    )
    today = core.stocks().filter(F.col("sk_date") == F.lit(AS_OF).cast("date")).select(
        F.col("sk_p_id").alias("df_p_id"),
        F.col("sk_s_id").alias("df_s_id"),
        F.col("sk_date").alias("df_date"),
        F.lit(None).cast("int").alias("df_closing_stocks"),
        F.col("sk_units").alias("closing"),
    )
    w = Window.partitionBy("df_p_id", "df_s_id").orderBy("df_date")
    return (
        later.unionByName(today)
        .withColumn("starting_inventory", F.lag("closing").over(w))
        .filter(F.col("df_date") > F.lit(AS_OF).cast("date"))
        .drop("closing")
    )


@query(
    "W12_previous_closing_stock",
    sql(
        "demandfulfillments",
        """select df_p_id, df_s_id, df_date, df_closing_stocks, lag(df_closing_stocks) over (
 partition by df_p_id, df_s_id order by df_date) starting_inventory from demandfulfillments""",
    ),
)
def _(core):
    w = Window.partitionBy("df_p_id", "df_s_id").orderBy("df_date")
    return core.demandfulfillments().select(
        "df_p_id", "df_s_id", "df_date", "df_closing_stocks",
        F.lag("df_closing_stocks").over(w).alias("starting_inventory"),
    )


@query(
    "W13_weekday_mean",
    sql(
        "sales",
        f"""select product_id, store_id, c_date, {", ".join(
            f"round(avg(x) over (partition by product_id, store_id, isodow(c_date) order by c_date range between interval {7 * n} day preceding and interval 1 day preceding), 6) mean_{n}w_log_units_sold"
            for n in (1, 2, 3, 4))} from series""",
        series=SERIES_SQL,
    ),
)
def _(core):
    return rounded(
        series(core).select(
            *KEY,
            *[features.weekday_mean("log_units_sold", n).alias(f"mean_{n}w_log_units_sold") for n in (1, 2, 3, 4)],
        )
    )


@query(
    "W14_same_day_mean",
    sql(
        "sales",
        f"""select a.product_id, a.store_id, a.c_date, {", ".join(
            f"round(avg(b.x) filter (b.c_date >= a.c_date - interval {n} year), 6) mean_{n}y_log_units_sold"
            for n in (1, 2, 3, 4))}
 from series a left join series b on a.product_id = b.product_id and a.store_id = b.store_id
 and dayofyear(a.c_date) = dayofyear(b.c_date) and b.c_date < a.c_date group by 1, 2, 3""",
        series=SERIES_SQL,
    ),
)
def _(core):
    return rounded(
        series(core).select(
            *KEY,
            *[features.same_day_mean("log_units_sold", n).alias(f"mean_{n}y_log_units_sold") for n in (1, 2, 3, 4)],
        )
    )


@query(
    "W15_upcoming_promotions",
    sql(
        "sales",
        f"""select product_id, store_id, c_date, {", ".join(
            f"cast(coalesce(sum(promo) over (partition by product_id, store_id order by c_date range between interval 1 day following and interval {n} day following), 0) as bigint) sum_next_{n}d_is_on_promotion"
            for n in (3, 7, 14))} from (select sa_p_id product_id, sa_s_id store_id, sa_date c_date,
 cast(max_disc >= 0.09 as int) promo from sales)""",
    ),
)
def _(core):
    s = core.sales().select(
        F.col("sa_p_id").alias("product_id"),
        F.col("sa_s_id").alias("store_id"),
        F.col("sa_date").alias("c_date"),
        (F.col("max_disc") >= 0.09).alias("is_on_promotion"),
    )
    return s.select(
        *KEY,
        *[features.upcoming_count("is_on_promotion", n).alias(f"sum_next_{n}d_is_on_promotion") for n in (3, 7, 14)],
    )


@query(
    "W16_two_row_min",
    sql(
        "sales",
        """select product_id, store_id, c_date, case when count(u) over w = 2 then min(u) over w end two_row_min
 from (select sa_p_id product_id, sa_s_id store_id, sa_date c_date,
 case when sa_units_sold <> 25 then sa_units_sold end u from sales)
 window w as (partition by product_id, store_id order by c_date rows between 1 preceding and current row)""",
    ),
)
def _(core):
    s = units(core).withColumn("u", F.when(F.col("units_sold") != 25, F.col("units_sold")))
    return s.select(*KEY, features.two_row_min("u").alias("two_row_min"))


@query(
    "W17_trailing_list",
    sql(
        "sales",
        """select product_id, store_id, c_date, cast(len(l) as int) n_values, array_to_string(l, ',') last_14d
 from (select sa_p_id product_id, sa_s_id store_id, sa_date c_date, list(sa_units_sold) over (partition by
 sa_p_id, sa_s_id order by sa_date range between interval 13 day preceding and current row) l from sales)""",
    ),
)
def _(core):
    s = units(core).withColumn("l", features.trailing_list("units_sold", 14))
    return s.select(
        *KEY,
        F.size("l").alias("n_values"),
        F.concat_ws(",", F.transform("l", lambda x: x.cast("string"))).alias("last_14d"),
    )


# --- matrices ----------------------------------------------------------------------------------


def n16(core, split_first=False):
    return features.feature_matrix(n1(core), SPLIT, split_first=split_first)


def n16_sql(split_first: bool = False) -> str:
    fill = ", ".join(
        f"last_value({c} ignore nulls) over (partition by product_id, store_id order by c_date"
        f" rows between unbounded preceding and current row) as {c}"
        for c in H_NAMES
    )
    split = f"c_date >= date '{SPLIT}'"
    part = f", {split}" if split_first else ""
    same = f"and (a.c_date >= date '{SPLIT}') = (b.c_date >= date '{SPLIT}')" if split_first else ""
    yearly = YEARLY_SQL.replace("and dayofyear(a", f"{same} and dayofyear(a")
    seasonal = seasonal_joins("m")
    if split_first:
        for h in H:
            seasonal = seasonal.replace(
                f"left join yearly y{h} on", f"left join yearly y{h} on (y{h}.c_date >= date '{SPLIT}') = (m.c_date >= date '{SPLIT}') and"
            )
    keep = ["c_date", "product_id", "store_id", "product_group"]
    keep += [f"next_{h}d_event_id" for h in H] + [f"next_{h}d_is_on_promo" for h in H]
    return sql(
        SNAP_TABLES,
        f"""select {", ".join("m." + c for c in keep)}, round(m.x, 6) log_units_sold,
 {", ".join(f"round(m.{c}, 6) {c}" for c in H_NAMES)}, m.c_date >= date '{SPLIT}' is_valid,
 cast(isodow(m.c_date) as int) dayofweek, cast(day(m.c_date) as int) dayofmonth,
 cast(dayofyear(m.c_date) as int) dayofyear, cast(weekofyear(m.c_date) as int) weekofyear,
 cast(month(m.c_date) as int) as "month", cast(year(m.c_date) as int) as "year",
 m.* exclude (c_date, product_id, store_id, product_group, x, {", ".join(keep[4:] + H_NAMES)}),
 {", ".join(f"round(y{h}.v, 6) h{h}_ewm_3y_log_units_sold" for h in H)}
 from rolled m {seasonal}""",
        snap=SNAP,
        n1=n1_body(),
        series="select product_id, store_id, c_date, log_units_sold x from n1",
        filled=f"select * exclude (log_units_sold) replace ({fill}), log_units_sold x from n1",
        rolled=f"select *, {rolling_sql('mean median std min max diff ratio', extra=part)} from filled",
        yearly=yearly,
    )


@query("N16_feature_matrix", n16_sql())
def _(core):
    return rounded(n16(core))


@query("N16_feature_matrix_split_first", n16_sql(split_first=True))
def _(core):
    return rounded(n16(core, split_first=True))
