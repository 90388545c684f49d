"""Registry of runnable queries and the SQL each result must equal.

``CORE_SQL`` states the core tables of :mod:`restock.sources.star_schema` in plain SQL, so every
check query starts from the raw star schema and shares no code with the Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from restock.sources.star_schema import StarSchema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2000-08-15"
TRAIN_FROM = "1995-01-01"
SPLIT = "1999-08-15"

_LINES = """select cast(substr(p_brand, 7) as int) p_id, n_regionkey s_id, n_nationkey from_nation,
 cast(s_suppkey % 6 as int) w_id, cast(l_shipdate as date) as "day", l_orderkey, l_suppkey, l_linenumber,
 l_quantity, l_extendedprice, l_discount, l_tax
 from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
 join nation on n_nationkey = s_nationkey"""

# name -> (tables it needs, body)
CORE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), _LINES),
    "sales": (
        ("lines",),
        """select p_id sa_p_id, s_id sa_s_id, "day" sa_date,
 cast(sum(l_quantity) as bigint) sa_units_sold, max(l_discount) max_disc
 from lines group by 1, 2, 3""",
    ),
    "products": (
        (),
        """select distinct cast(substr(p_brand, 7) as int) p_id, p_brand p_name,
 concat('GROUP_', cast(cast(substr(p_brand, 7) as int) % 5 as varchar)) p_group from part""",
    ),
    "stores": (
        (),
        """select r_regionkey s_id, r_name s_name, s_longitude, s_latitude from region left join (
 select n_regionkey, round(max(c_acctbal) / 100, 4) s_longitude, round(min(c_acctbal) / 100, 4) s_latitude
 from customer join nation on c_nationkey = n_nationkey group by 1) on n_regionkey = r_regionkey""",
    ),
    "workshops": (
        (),
        """select cast(s_suppkey % 6 as int) w_id, concat('WORKSHOP_', cast(s_suppkey % 6 as varchar)) w_name,
 cast(150 + 50 * (s_suppkey % 6) as int) w_capacity, round(max(s_acctbal) / 100, 4) w_longitude,
 round(min(s_acctbal) / 100, 4) w_latitude from supplier group by s_suppkey % 6""",
    ),
    "promotions": (
        ("sales",),
        """select sa_p_id pr_p_id, sa_s_id pr_s_id, sa_date pr_date, 1 pr_id from sales
 where max_disc >= 0.09""",
    ),
    "all_eventstores": (
        ("lines",),
        """select distinct l_linenumber es_e_id, s_id es_s_id, "day" es_date from lines
 where l_discount >= 0.095 and l_tax >= 0.075""",
    ),
    # one event per store-day: the smallest id
    "eventstores": (
        ("all_eventstores",),
        "select es_s_id, es_date, min(es_e_id) es_e_id from all_eventstores group by 1, 2",
    ),
    "transportlinks": (
        ("lines",),
        """select p tl_p_id, s tl_s_id, w tl_w_id,
 cast(round(0.1 + ((p * 3 + s * 5 + w * 7) % 11) / 10.0, 2) as double) tl_package_cost,
 cast(5 + (p * 7 + s * 3 + w) % 16 as int) tl_package_size
 from (select distinct p_id p, s_id s, w_id w from lines)""",
    ),
    "procurements": (
        ("sales",),
        """select sa_p_id pc_p_id, sa_s_id pc_s_id, min(sa_date) pc_active_from,
 cast(max(sa_date) + interval 1 day as date) pc_active_upto, 1 pc_id
 from sales group by sa_p_id, sa_s_id, date_trunc('month', sa_date)""",
    ),
    "demandpredictions": (
        ("sales",),
        """select sa_p_id dp_p_id, sa_s_id dp_s_id, cast(sa_date + interval 7 day as date) dp_date,
 cast(sa_units_sold as int) dp_mean from sales""",
    ),
    "stocks": (
        ("sales",),
        """select sa_p_id sk_p_id, sa_s_id sk_s_id, sa_date sk_date,
 cast(sa_units_sold + 10 as int) sk_units from sales""",
    ),
    "procurementplans": (
        ("lines",),
        """select p_id pl_p_id, s_id pl_s_id, w_id pl_w_id, "day" pl_date,
 cast(sum(l_quantity) as int) pl_expected_units from lines group by 1, 2, 3, 4""",
    ),
    "demandfulfillments": (
        ("sales",),
        """select sa_p_id df_p_id, sa_s_id df_s_id, sa_date df_date,
 cast(least(sa_units_sold, 40) + greatest(0, 60 - sa_units_sold) as int) df_initial_stocks,
 cast(greatest(0, 60 - sa_units_sold) as int) df_closing_stocks,
 cast(least(sa_units_sold, 40) as int) df_met_demand,
 cast(greatest(0, sa_units_sold - 40) as int) df_unmet_demand from sales""",
    ),
    "core_events": (
        (),
        """select l_linenumber e_id, concat('EVENT_', cast(l_linenumber as varchar)) e_name,
 min(l_returnflag) e_type, max(l_linestatus) e_locality from lineitem group by l_linenumber""",
    ),
    "flows": (
        (),
        """select c_nationkey src, s_nationkey dst, count(*) n_lines,
 cast(sum(l_linenumber) as bigint) line_sum, cast(sum(l_quantity) as bigint) quantity
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
 join supplier on s_suppkey = l_suppkey group by 1, 2""",
    ),
}


def calendar_sql(as_of: str = AS_OF, window: int = 7) -> str:
    return f"""select cast(d as date) c_date, cast(row_number() over (order by d) as int) c_rank
 from generate_series(date '{as_of}' + interval 1 day, date '{as_of}' + interval {window} day,
 interval 1 day) as t(d)"""


def _with(*names: str) -> list[tuple[str, str]]:
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in ordered:
            return
        needs, body = CORE_SQL[name]
        for need in needs:
            visit(need)
        ordered[name] = body

    for name in names:
        visit(name)
    return list(ordered.items())


def sql(tables: str, body: str, **more: str) -> str:
    """``body`` below WITH clauses for the named core tables and any extra named subqueries."""
    parts = _with(*tables.split()) + list(more.items())
    if not parts:
        return body
    clauses = ",\n".join(f"{name} as materialized ({text})" for name, text in parts)
    return f"with recursive {clauses}\n{body}"


def query(key: str, oracle: str | None = None):
    """Register ``fn(core: StarSchema) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[StarSchema], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(StarSchema(spark, folder))
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def r6(column):
    """Round to 6 places; adding 0.0 turns -0.0 into 0.0."""
    from pyspark.sql import functions as F

    return F.round(column, 6) + F.lit(0.0)
