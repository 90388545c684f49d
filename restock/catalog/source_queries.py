"""Sources, sinks, integrity jobs and dataset extraction: S1–S14, I1–I7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.catalog.registry import AS_OF, query, sql
from restock.operators import integrity, relational
from restock.plans import extract
from restock.schemas import CORE_TABLES
from restock.session import staging_path
from restock.sources import tables, text_instances

SALES_SQL = "select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales"


def plain_sales(core):
    return core.sales().drop("max_disc")


# --- S1–S8: tables -----------------------------------------------------------------------------


@query("S1_landing_read", sql("sales", SALES_SQL))
def _(core):
    root = staging_path(core.spark, "landing")
    tables.write_parquet(plain_sales(core), tables.landing_path(root, AS_OF, "sales"))
    return tables.read_landing(core.spark, root, AS_OF, "sales")


@query("S2_parquet_round_trip", sql("sales", f"select *, cast(year(sa_date) as int) sales_year from ({SALES_SQL})"))
def _(core):
    path = staging_path(core.spark, "sales_by_year")
    tables.write_parquet(
        plain_sales(core).withColumn("sales_year", F.year("sa_date")), path, "zstd", ["sales_year"]
    )
    return tables.scan_parquet(core.spark, path)


@query("S3_csv_scan", sql("sales", SALES_SQL))
def _(core):
    path = staging_path(core.spark, "sales_csv")
    plain_sales(core).write.csv(path, header=True)
    schema = "sa_p_id INT, sa_s_id INT, sa_date DATE, sa_units_sold BIGINT"
    return tables.scan_csv(core.spark, path, schema)


@query("S4_parquet_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 300000")
def _(core):
    return (
        tables.scan_parquet(core.spark, f"{core.folder}/orders.parquet")
        .filter("o_totalprice > 300000")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query(
    "S5_sql_text",
    sql(
        "sales products",
        """select p_group, sa_s_id, cast(sum(sa_units_sold) as bigint) units from sales
 left join products on p_id = sa_p_id group by 1, 2""",
    ),
)
def _(core):
    return tables.run_sql(
        core.spark,
        """select p_group, sa_s_id, sum(sa_units_sold) as units from {sales}
           left join {products} on p_id = sa_p_id group by p_group, sa_s_id""",
        sales=core.sales(),
        products=core.products(),
    )


@query(
    "S6_sql_over_stored_tables",
    sql("demandfulfillments", "select df_s_id, cast(sum(df_unmet_demand) as bigint) unmet from demandfulfillments group by 1"),
)
def _(core):
    store = tables.write_parquet(core.demandfulfillments(), staging_path(core.spark, "fulfilments"))
    return tables.run_sql(
        core.spark,
        "select df_s_id, sum(df_unmet_demand) as unmet from {f} group by df_s_id",
        f=tables.scan_parquet(core.spark, store),
    )


def dimension_batches(core):
    products = core.products().select("p_name", "p_group")
    stores = core.stores().select("s_name", "s_longitude", "s_latitude")
    return products, stores


def loaded_store(core) -> integrity.CoreStore:
    """Dimensions and named sales loaded through the validated path, sales in two batches."""
    store = integrity.CoreStore(core.spark, staging_path(core.spark, "core"))
    products, stores = dimension_batches(core)
    store.append("products", products)
    store.append("stores", stores)
    named = named_sales(core)
    split = F.lit("1998-01-01").cast("date")
    for part in (named.filter(F.col("sa_date") < split), named.filter(F.col("sa_date") >= split)):
        store.append("sales", map_sales(part, store))
    return store


def named_sales(core):
    return (
        core.sales()
        .join(core.products(), F.col("sa_p_id") == F.col("p_id"))
        .join(core.stores(), F.col("sa_s_id") == F.col("s_id"))
        .select("p_name", "s_name", "sa_date", "sa_units_sold")
    )


def map_sales(batch, store):
    return integrity.map_batch(
        batch,
        {
            "p_name": (store.table("products"), "p_name", "p_id"),
            "s_name": (store.table("stores"), "s_name", "s_id"),
        },
        {"p_name": "sa_p_id", "s_name": "sa_s_id"},
    )


@query(
    "S7_table_sink",
    sql("sales products stores", """select p_name, s_name, sa_date, cast(sa_units_sold as int) sa_units_sold from sales
 join products on p_id = sa_p_id join stores on s_id = sa_s_id"""),
)
def _(core):
    store = loaded_store(core)
    return (
        store.table("sales")
        .join(store.table("products"), F.col("p_id") == F.col("sa_p_id"))
        .join(store.table("stores"), F.col("s_id") == F.col("sa_s_id"))
        .select("p_name", "s_name", "sa_date", "sa_units_sold")
    )


@query(
    "S8_read_core_tables",
    sql(
        "products stores workshops sales",
        """select 'products' as "table", count(*) n from products union all select 'stores', count(*) from stores
 union all select 'workshops', count(*) from workshops union all select 'promotions', count(*) from sales where max_disc >= 0.09""",
    ),
)
def _(core):
    store = integrity.CoreStore(core.spark, staging_path(core.spark, "core"))
    products, stores = dimension_batches(core)
    store.append("products", products)
    store.append("stores", stores)
    store.append("workshops", core.workshops().drop("w_id"))
    named = (
        core.promotions()
        .join(core.products(), F.col("pr_p_id") == F.col("p_id"))
        .join(core.stores(), F.col("pr_s_id") == F.col("s_id"))
        .select("p_name", "s_name", "pr_date")
    )
    mapped = integrity.map_batch(
        named,
        {
            "p_name": (store.table("products"), "p_name", "p_id"),
            "s_name": (store.table("stores"), "s_name", "s_id"),
        },
        {"p_name": "pr_p_id", "s_name": "pr_s_id"},
    )
    store.append("promotions", mapped)
    parts = [
        store.table(name)
        .agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("table"), "n")
        for name in ("products", "stores", "workshops", "promotions")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- S9–S14: text instances --------------------------------------------------------------------


def write_text_files(lines: DataFrame, path: str) -> str:
    """One text file per ``instance``: its lines in ``line_no`` order. Instances are small by
    construction (a month of aggregated cells)."""
    (
        lines.repartition("instance")
        .sortWithinPartitions("instance", "line_no")
        .select("instance", F.col("text").alias("value"))
        .write.partitionBy("instance")
        .text(path)
    )
    return path


def instance_of(df: DataFrame) -> DataFrame:
    number = F.regexp_extract("file", r"instance=([0-9]+)", 1).cast("int")
    return df.withColumn("instance", number).drop("file")


def nation_keys(core) -> list[int]:
    """The nation numbers, which name the rows and columns of the matrices."""
    return [r.n_nationkey for r in core.raw("nation").select("n_nationkey").orderBy("n_nationkey").collect()]


def month_cells(core) -> DataFrame:
    return core.monthly_flows().withColumnRenamed("month_no", "instance")


MONTH_SQL = """select cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as "instance", c_nationkey src, s_nationkey dst,
 count(*) n_lines, cast(sum(l_linenumber) as bigint) line_sum, cast(sum(l_quantity) as bigint) quantity
 from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
 join supplier on s_suppkey = l_suppkey group by 1, 2, 3"""


def edge_instance(core) -> str:
    """Files with comments, a sizes line and 1-based edges."""
    cells = month_cells(core)
    n = len(nation_keys(core))
    head = cells.groupBy("instance").agg(F.count("*").alias("n")).select(
        "instance",
        F.posexplode(
            F.array(F.lit("# from to lines quantity"), F.lit(""), F.concat(F.lit(f"{n} "), F.col("n").cast("string"), F.lit(" 40")))
        ).alias("line_no", "text"),
    )
    body = cells.select(
        "instance",
        (F.col("src") * n + F.col("dst") + 10).alias("line_no"),
        F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "n_lines", "quantity").alias("text"),
    )
    return write_text_files(head.unionByName(body), staging_path(core.spark, "edges"))


@query(
    "S9_text_instance",
    sql("", """select "instance", cast((select count(*) from nation) as int) n_nodes, n n_edges, 40 budget, src + 1 src, dst + 1 dst, n_lines, quantity
 from m join (select "instance", count(*) n from m group by 1) using ("instance")""", m=MONTH_SQL),
)
def _(core):
    meta, rows = text_instances.read_instance(
        core.spark, edge_instance(core), ["n_nodes", "n_edges", "budget"], ["src", "dst", "n_lines", "quantity"]
    )
    joined = instance_of(rows.join(meta, "file")).drop("line_no")
    return joined.withColumns({c: F.col(c).cast("int") for c in ("n_nodes", "budget", "src", "dst")})


@query("S12_zero_based_index", sql("", """select "instance", src, dst, n_lines from m""", m=MONTH_SQL))
def _(core):
    _, rows = text_instances.read_instance(
        core.spark, edge_instance(core), ["n_nodes", "n_edges", "budget"], ["src", "dst", "n_lines", "quantity"]
    )
    shifted = text_instances.shift_to_zero_based(instance_of(rows), ["src", "dst"])
    return shifted.select("instance", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "n_lines")


FULL_MATRIX_SQL = """select g."instance", g.src as "row", g.dst as "col", cast(coalesce(quantity, 0) as double) as cost
 from (select i."instance", a.n_nationkey src, b.n_nationkey dst from (select distinct "instance" from m) i
 cross join nation a cross join nation b) g left join m on m."instance" = g."instance" and m.src = g.src and m.dst = g.dst"""


def full_cells(core) -> DataFrame:
    """Every nation pair of every month; pairs without flow have quantity 0."""
    cells = month_cells(core)
    nations = core.raw("nation").select("n_nationkey")
    pairs = relational.full_grid(nations.toDF("src"), nations.toDF("dst"))
    grid = relational.full_grid(pairs, cells.select("instance").distinct())
    return grid.join(cells.select("instance", "src", "dst", "quantity", "line_sum"), ["instance", "src", "dst"], "left").fillna(0)


@query("S10_wrapped_matrix", sql("", FULL_MATRIX_SQL, m=MONTH_SQL))
def _(core):
    nations = nation_keys(core)
    rows = full_cells(core).groupBy("instance", "src").pivot("dst", nations).agg(F.sum("quantity"))
    # a row is wrapped over lines of at most 10 values
    pieces = [
        F.concat_ws(" ", *[F.col(str(c)).cast("string") for c in nations[a : a + 10]])
        for a in range(0, len(nations), 10)
    ]
    body = rows.select("instance", "src", F.posexplode(F.array(*pieces)).alias("k", "text")).select(
        "instance", (F.col("src") * len(pieces) + F.col("k") + 1).alias("line_no"), "text"
    )
    head = rows.select("instance").distinct().select("instance", F.lit(0).alias("line_no"), F.lit(str(len(nations))).alias("text"))
    path = write_text_files(head.unionByName(body), staging_path(core.spark, "matrix"))
    matrix = instance_of(text_instances.read_wrapped_matrix(core.spark, path))
    return matrix.withColumns({c: F.col(c).cast("int") for c in ("row", "col")})


@query(
    "S11_alternating_lines",
    sql(
        "",
        """select "instance", src customer_id, dst warehouse_id, cast(d as bigint) demand,
 quantity / d unit_cost from (select *, sum(quantity) over (partition by "instance", src) + 1 d
 from (select "instance", "row" src, "col" dst, cost quantity from full_m))""",
        m=MONTH_SQL,
        full_m=FULL_MATRIX_SQL,
    ),
)
def _(core):
    nations = nation_keys(core)
    n = len(nations)
    rows = full_cells(core).groupBy("instance", "src").pivot("dst", nations).agg(F.sum("quantity"))
    values = [F.col(str(c)) for c in nations]
    total = sum(values[1:], values[0]) + 1
    lines = F.array(total.cast("string"), F.concat_ws(" ", *[v.cast("string") for v in values]))
    body = rows.select("instance", "src", F.posexplode(lines).alias("k", "text")).select(
        "instance", (F.col("src") * 2 + F.col("k") + n + 1).alias("line_no"), "text"
    )
    months = rows.select("instance").distinct()
    head = months.select(
        "instance",
        F.posexplode(F.array(F.lit(f"{n} {n}"), *[F.lit(f"{1000 + w} {w}.5") for w in nations])).alias("line_no", "text"),
    )
    path = write_text_files(head.unionByName(body), staging_path(core.spark, "warehouses"))
    _, demands, costs = text_instances.read_warehouse_instance(core.spark, path)
    joined = instance_of(costs.join(demands, ["file", "customer_id"]))
    return joined.select(
        "instance",
        F.col("customer_id").cast("int").alias("customer_id"),
        F.col("warehouse_id").cast("int").alias("warehouse_id"),
        "demand",
        "unit_cost",
    )


@query(
    "S13_block_file",
    sql(
        "sales products stores",
        """select cast(year(sa_date) * 12 + month(sa_date) as int) as "instance", p_name, s_name, sa_date as period,
 cast(sa_units_sold as int) mean, 100 penalty from sales join products on p_id = sa_p_id join stores on s_id = sa_s_id""",
    ),
)
def _(core):
    month = (F.year("sa_date") * 12 + F.month("sa_date")).cast("int")
    rows = named_sales(core).withColumn("instance", month)
    demand = rows.select(
        "instance",
        F.concat(F.lit("2"), F.col("p_name"), F.col("s_name"), F.col("sa_date").cast("string")).alias("line_no"),
        F.concat(
            F.lit("['"), F.col("p_name"), F.lit("','"), F.col("s_name"), F.lit("','"),
            F.date_format("sa_date", "yyyy-dd-MM"), F.lit("'] "), F.col("sa_units_sold").cast("string"),
        ).alias("text"),
    )
    names = rows.select("instance", "p_name").distinct().select(
        "instance", F.concat(F.lit("1"), F.col("p_name")).alias("line_no"), F.concat(F.lit("'"), F.col("p_name"), F.lit("'")).alias("text")
    )
    frame = F.array(
        *[
            F.struct(F.lit(no).alias("line_no"), F.lit(text).alias("text"))
            for no, text in [("0", "set PRODUCTS :="), ("1~", ";"), ("1~~", "param Demand :="), ("2~", ";"), ("3", "param Unmet := 100;")]
        ]
    )
    heads = rows.select("instance").distinct().select("instance", F.inline(frame))
    path = write_text_files(
        demand.unionByName(names).unionByName(heads), staging_path(core.spark, "blocks")
    )
    records = instance_of(text_instances.read_blocks(core.spark, path))
    penalty = records.filter("block = 'Unmet'").select("instance", F.col("value").alias("penalty"))
    item = lambda i: F.get("items", F.lit(i))
    return (
        records.filter("block = 'Demand'")
        .join(penalty, "instance")
        .select(
            "instance",
            item(0).alias("p_name"),
            item(1).alias("s_name"),
            F.to_date(item(2), "yyyy-dd-MM").alias("period"),
            F.col("value").alias("mean"),
            "penalty",
        )
    )


@query(
    "S14_literal_frame",
    sql(
        "sales",
        """select label, cast(count(*) as bigint) n, cast(sum(sa_units_sold) as bigint) units from sales
 join (values (0, 10, 'small'), (11, 30, 'medium'), (31, null, 'large')) t(lo, hi, label)
 on sa_units_sold >= lo and (hi is null or sa_units_sold <= hi) group by 1""",
    ),
)
def _(core):
    rows = [(0, 10, "small"), (11, 30, "medium"), (31, None, "large")]  # the top band is open
    bands = tables.literal_frame(core.spark, rows, "lo BIGINT, hi BIGINT, label STRING")
    in_band = (F.col("sa_units_sold") >= F.col("lo")) & (
        F.col("hi").isNull() | (F.col("sa_units_sold") <= F.col("hi"))
    )
    return (
        core.sales()
        .join(F.broadcast(bands), in_band)  # three literal rows
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.sum("sa_units_sold").alias("units"))
    )


# --- I1–I6 -------------------------------------------------------------------------------------


@query(
    "I1_validated_append",
    sql("sales", "select count(*) n, cast(1 as bigint) first_id, count(*) last_id, count(*) n_ids from sales"),
)
def _(core):
    stored = loaded_store(core).table("sales")
    return stored.agg(
        F.count("*").alias("n"),
        F.min("sa_id").alias("first_id"),
        F.max("sa_id").alias("last_id"),
        F.count_distinct("sa_id").alias("n_ids"),
    )


@query(
    "I1_rejected_append",
    sql(
        "sales",
        """select false written, (select count(*) from sales) stored, 'unique' as "rule", count(*) n from sales
 where sa_date >= date '2001-01-01'""",
    ),
)
def _(core):
    store = loaded_store(core)
    again = map_sales(named_sales(core).filter(F.col("sa_date") >= F.lit("2001-01-01").cast("date")), store)
    result = store.append("sales", again)
    stored = store.table("sales").agg(F.count("*")).scalar()
    return result.violations.groupBy("rule").agg(F.count("*").alias("n")).select(
        F.lit(result.written).alias("written"), stored.alias("stored"), "rule", "n"
    )


def line_batch(core):
    """Raw order lines shaped like sales: keys repeat."""
    return core._lines().select(
        F.col("p_id").alias("sa_p_id"),
        F.col("s_id").alias("sa_s_id"),
        F.col("day").alias("sa_date"),
        F.col("l_quantity").alias("sa_units_sold"),
    )


@query(
    "I2_unique_key_check",
    sql(
        "lines sales",
        """select 'unique' as "rule", concat(p, '|', s, '|', d) as "key", n + (st is not null)::int as rows from (
 select p_id p, s_id s, "day" d, count(*) n from lines where "day" >= date '1999-01-01' group by 1, 2, 3)
 left join (select sa_p_id, sa_s_id, sa_date, 1 st from sales where sa_date < date '2000-01-01') on sa_p_id = p and sa_s_id = s and sa_date = d
 where n + (st is not null)::int > 1""",
    ),
)
def _(core):
    batch = line_batch(core).filter(F.col("sa_date") >= F.lit("1999-01-01").cast("date"))
    stored = core.sales(date_upto="1999-12-31")
    return integrity.duplicate_keys(batch, stored, CORE_TABLES["sales"].unique)


@query(
    "I3_reference_check",
    sql(
        "sales products",
        """select 'reference sa_p_id' as "rule", cast(sa_p_id as varchar) as "key", count(*) as rows from sales
 where sa_p_id not in (select p_id from products where p_group <> 'GROUP_3') group by 2""",
    ),
)
def _(core):
    known = core.products().filter("p_group != 'GROUP_3'")
    return integrity.missing_references(core.sales(), "sa_p_id", known, "p_id")


@query(
    "I4_range_check",
    """select 'check balance' as "rule", cast(c_custkey as varchar) as "key", cast(1 as bigint) as rows from customer
 where not (c_acctbal >= 0) union all select 'check segment', cast(c_custkey as varchar), 1 from customer
 where not (c_mktsegment <> 'MACHINERY')""",
)
def _(core):
    checks = {"balance": "c_acctbal >= 0", "segment": "c_mktsegment <> 'MACHINERY'"}
    return integrity.range_violations(core.raw("customer"), checks, ["c_custkey"])


@query(
    "I5_map_and_rename",
    sql("sales", "select sa_p_id, sa_s_id, sa_date, sa_units_sold from sales"),
)
def _(core):
    return integrity.map_batch(
        named_sales(core),
        {
            "p_name": (core.products(), "p_name", "p_id"),
            "s_name": (core.stores(), "s_name", "s_id"),
        },
        {"p_name": "sa_p_id", "s_name": "sa_s_id"},
    )


@query(
    "I6_partial_update",
    """select c_custkey, c_name, c_nationkey, case when c_acctbal < 0 then 0.0 else c_acctbal end c_acctbal,
 case when c_acctbal < 0 and c_mktsegment <> 'BUILDING' then 'REVIEW' else c_mktsegment end c_mktsegment from customer""",
)
def _(core):
    customers = core.raw("customer")
    changes = customers.filter("c_acctbal < 0").select(
        "c_custkey",
        F.lit(0.0).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") != "BUILDING", "REVIEW").alias("c_mktsegment"),
    )
    return integrity.patched_table(customers, changes, "c_custkey")


@query(
    "I6_store_patch",
    sql(
        "workshops",
        """select w_name, cast(case when w_id % 2 = 0 then 999 else w_capacity end as int) w_capacity, cast(2 as bigint) n_unknown,
 true refused from workshops""",
    ),
)
def _(core):
    """Every second workshop gets a new capacity, two ids do not exist, and a negative capacity is refused."""
    store = integrity.CoreStore(core.spark, staging_path(core.spark, "core"))
    store.append("workshops", core.workshops().drop("w_id"))
    number = F.regexp_extract("w_name", "([0-9]+)$", 1).cast("int")
    known = store.table("workshops").filter(number % 2 == 0).select("w_id", F.lit(999).alias("w_capacity"))
    strangers = core.spark.createDataFrame([(-1, 5), (-2, 5)], "w_id BIGINT, w_capacity INT")
    unknown = store.patch("workshops", known.unionByName(strangers)).agg(F.count("*")).scalar()
    refused = False
    try:
        store.patch("workshops", known.withColumn("w_capacity", F.lit(-1)))
    except ValueError:
        refused = True
    return store.table("workshops").select(
        "w_name", "w_capacity", unknown.alias("n_unknown"), F.lit(refused).alias("refused")
    )


# --- I7: raw files to landing tables -----------------------------------------------------------

RAW_SQL = {
    "train": """select row_number() over () id, strftime(sa_date, '%Y-%m-%d') "date", sa_s_id store_nbr, sa_p_id item_nbr,
 cast(sa_units_sold - 3 as double) unit_sales, case when max_disc >= 0.09 then 'True' when max_disc < 0.05 then 'False' end onpromotion from sales""",
    "item_names": "select p_id item_nbr, p_name from products where p_group <> 'GROUP_4'",
    "holidays": """select l_shipdate, cast("day" as varchar) "date", l_returnflag as "type", l_linestatus locale, r_name locale_name,
 concat(case when l_quantity > 25 then 'Traslado ' else '' end, 'EVENT_', l_linenumber) description,
 case when l_tax > 0.07 and l_quantity > 40 then 'True' else 'False' end transferred
 from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey,
 lateral (select cast(l_shipdate as date) "day") where l_discount >= 0.095 and l_tax >= 0.075""",
    "days": """select distinct regexp_replace(description, 'Traslado ', '') e_name, cast("date" as date) es_date, "type" e_type, locale e_locality
 from holidays where transferred = 'False' and locale_name in ('AFRICA', 'ASIA', 'EUROPE', 'REGION_0', 'REGION_1')
 and regexp_replace(description, 'Traslado ', '') not in ('EVENT_7')""",
}


def raw_sql(tables_: str, body: str, *names: str) -> str:
    return sql(tables_, body, **{n: RAW_SQL[n] for n in names})


def raw_train(core):
    """Written as CSV and scanned with the declared schema, as the raw files arrive."""
    flag = F.when(F.col("max_disc") >= 0.09, "True").when(F.col("max_disc") < 0.05, "False")
    rows = core.sales().select(
        F.monotonically_increasing_id().alias("id"),
        F.col("sa_date").cast("string").alias("date"),
        F.col("sa_s_id").alias("store_nbr"),
        F.col("sa_p_id").alias("item_nbr"),
        (F.col("sa_units_sold") - 3).cast("double").alias("unit_sales"),
        flag.alias("onpromotion"),
    )
    path = staging_path(core.spark, "train_csv")
    rows.write.csv(path, header=True)
    return tables.scan_csv(core.spark, path, extract.TRAIN_SCHEMA)


def item_names(core):
    return core.products().filter("p_group != 'GROUP_4'").select(F.col("p_id").alias("item_nbr"), "p_name")


def store_names(core):
    return core.stores().select(F.col("s_id").alias("store_nbr"), "s_name")


def raw_holidays(core):
    lines = core.raw("lineitem").filter("l_discount >= 0.095 and l_tax >= 0.075")
    place = (
        core.raw("supplier")
        .join(core.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(core.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("locale_name"))
    )
    moved = F.when(F.col("l_quantity") > 25, extract.MOVED_PREFIX).otherwise("")
    return lines.join(place, "l_suppkey").select(
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("locale"),
        "locale_name",
        F.concat(moved, F.lit("EVENT_"), F.col("l_linenumber").cast("string")).alias("description"),
        F.when((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 40), "True").otherwise("False").alias("transferred"),
    )


LOCALES = ["AFRICA", "ASIA", "EUROPE", "REGION_0", "REGION_1"]


def holiday_days(core):
    return extract.holidays(raw_holidays(core), LOCALES, ["EVENT_7"]).distinct()


SOLD_SQL = """select cast("date" as date) sa_date, s_name, p_name, unit_sales sa_units_sold,
 onpromotion is not null and onpromotion = 'True' is_on_promotion from train
 join item_names using (item_nbr) join stores on s_id = store_nbr where unit_sales > 0"""


@query(
    "I7_sales_split",
    sql("sales products stores", """select *, case when sa_date <= date '2000-08-15' then 'train' else 'valid' end part
 from (select * exclude (is_on_promotion) from sold)""", train=RAW_SQL["train"], item_names=RAW_SQL["item_names"], sold=SOLD_SQL),
)
def _(core):
    lines = extract.sold_lines(raw_train(core), item_names(core), store_names(core))
    train, valid = extract.sales_split(lines, AS_OF)
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@query(
    "I7_promotions",
    sql("sales products stores", "select sa_date pr_date, p_name, s_name from sold where is_on_promotion",
        train=RAW_SQL["train"], item_names=RAW_SQL["item_names"], sold=SOLD_SQL),
)
def _(core):
    return extract.promotions(extract.sold_lines(raw_train(core), item_names(core), store_names(core)))


@query(
    "I7_events",
    raw_sql("", """select e_name, arg_min(e_type, (es_date, e_type, e_locality)) e_type,
 arg_min(e_locality, (es_date, e_type, e_locality)) e_locality from days group by 1""", "holidays", "days"),
)
def _(core):
    return extract.events(holiday_days(core))


@query("I7_eventstores", raw_sql("stores", "select e_name, es_date, s_name from days cross join stores", "holidays", "days"))
def _(core):
    return extract.eventstores(holiday_days(core), core.stores())


@query(
    "I7_products",
    raw_sql("products", """select p_name, cast(sum(p_size) % 2 as int) = 1 p_is_perishable, cast(max(p_size) as varchar) p_cluster,
 min(p_type) p_group from part join (select p_name brand, item_nbr from item_names) on brand = p_brand,
 lateral (select p_brand) group by brand, item_nbr""".replace("select p_name, cast", "select brand p_name, cast"), "item_names"),
)
def _(core):
    items = core.raw("part").groupBy(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("item_nbr")).agg(
        F.min("p_type").alias("family"), F.max("p_size").alias("class"), (F.sum("p_size") % 2).cast("int").alias("perishable")
    )
    return extract.products(items, item_names(core))


@query(
    "I7_stores",
    sql("stores", """select s_name, min(n_name) s_city, max(n_name) s_state, 'Ecuador' s_country, 'A' s_type,
 cast(count(*) as varchar) s_cluster, s_longitude, s_latitude from stores join nation on n_regionkey = s_id
 group by s_name, s_longitude, s_latitude"""),
)
def _(core):
    raw = core.raw("nation").groupBy(F.col("n_regionkey").alias("store_nbr")).agg(
        F.min("n_name").alias("city"), F.max("n_name").alias("state"), F.lit("A").alias("type"), F.count("*").alias("cluster")
    )
    places = core.stores().select("s_name", "s_longitude", "s_latitude")
    return extract.stores(raw, store_names(core), places)


@query(
    "I7_stocks_and_procurements",
    sql("stores", """select s_name, p_name, 100 sk_units, date '2000-08-15' sk_date, date '2016-01-01' pc_active_from,
 date '9999-12-31' pc_active_upto from stores cross join (select unnest(['Donut', 'Croissant']) p_name)"""),
)
def _(core):
    makes = ["Donut", "Croissant"]
    stocks = extract.opening_stocks(store_names(core), makes, AS_OF)
    return stocks.join(extract.procurement_windows(store_names(core), makes), ["s_name", "p_name"])


@query(
    "I7_transport_links",
    sql(
        "products stores workshops",
        """select p_name, s_name, w_name, round(0.1 + (dist - lo) / (hi - lo), 2) tl_package_cost,
 cast(w_capacity // 25 as int) tl_package_size from d cross join (select min(dist) lo, max(dist) hi from d)""",
        d="""select p_name, s_name, w_name, w_capacity, abs(w_longitude - s_longitude) + abs(w_latitude - s_latitude) dist
 from workshops join products on p_id % 6 = w_id cross join stores""",
    ),
)
def _(core):
    made = core.products().select(
        F.concat(F.lit("WORKSHOP_"), (F.col("p_id") % 6).cast("string")).alias("w_name"), "p_name"
    )
    return extract.transport_links(core.workshops(), made, core.stores())
