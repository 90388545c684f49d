"""Readers for text instances: numbered lines, wrapped matrices, alternating lines, named blocks.

A file may be split over many tasks. Lines are numbered per file from the block offset and the
position inside the block, so no file passes through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.operators.running import bucketed_running_total

_BUCKET_LINES = 100_000


def numbered_lines(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """(file, line_no, text) with 0-based numbers over the kept lines.

    Blank lines and lines starting with ``#`` are dropped unless ``skip_comments`` is off.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"),
    )
    if skip_comments:
        raw = raw.filter((F.col("text") != "") & ~F.col("text").startswith("#"))
    # ids grow by one per kept line while a task reads a block
    placed = raw.withColumn("seq", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "block").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n_lines")
    )
    starts = bucketed_running_total(
        blocks.withColumn("bucket", F.lit(0)), ["file"], ["bucket"], ["block"], "n_lines", "upto"
    ).select("file", "block", "first_seq", (F.col("upto") - F.col("n_lines")).alias("before"))
    return placed.join(starts, ["file", "block"]).select(
        "file", (F.col("before") + F.col("seq") - F.col("first_seq")).alias("line_no"), "text"
    )


def numbers(text: Column, kind: str = "bigint") -> Column:
    return F.transform(F.split(text, " "), lambda t: t.cast(kind))


def read_instance(
    spark: SparkSession, path: str, header: Sequence[str], columns: Sequence[str], kind="bigint"
) -> tuple[DataFrame, DataFrame]:
    """(metadata, rows): the first kept line of each file names sizes, later lines are records."""
    lines = numbered_lines(spark, path).withColumn("n", numbers(F.col("text"), kind))
    pick = lambda names: [F.get("n", F.lit(i)).alias(c) for i, c in enumerate(names)]
    meta = lines.filter("line_no = 0").select("file", *pick(header))
    rows = lines.filter("line_no > 0").select("file", "line_no", *pick(columns))
    return meta, rows


def shift_to_zero_based(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) - 1 for c in columns})


def read_wrapped_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, cost) of an n×n matrix whose rows are wrapped over any number of lines.

    The first line holds n. A value's place follows from the count of values before its line.
    """
    lines = numbered_lines(spark, path).withColumn("n", numbers(F.col("text"), "double"))
    size = lines.filter("line_no = 0").select("file", F.get("n", F.lit(0)).cast("long").alias("width"))
    body = lines.filter("line_no > 0").select(
        "file",
        "line_no",
        "n",
        F.size("n").cast("long").alias("len"),
        F.expr(f"line_no div {_BUCKET_LINES}").alias("bucket"),
    )
    placed = bucketed_running_total(body, ["file"], ["bucket"], ["line_no"], "len", "upto")
    return (
        placed.select("file", (F.col("upto") - F.col("len")).alias("start"), F.posexplode("n"))
        .join(size, "file")
        .select(
            "file",
            F.expr("(start + pos) div width").alias("row"),
            ((F.col("start") + F.col("pos")) % F.col("width")).alias("col"),
            F.col("col").alias("cost"),
        )
    )


def read_warehouse_instance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(warehouses, demands, unit costs) of a file with a sizes line, one line per warehouse
    (capacity, opening cost), then a demand line and a cost line for each client."""
    lines = numbered_lines(spark, path).withColumn("n", numbers(F.col("text"), "double"))
    size = lines.filter("line_no = 0").select(
        "file", F.get("n", F.lit(0)).cast("long").alias("n_warehouses")
    )
    body = lines.filter("line_no > 0").join(size, "file").withColumn(
        "k", F.col("line_no") - 1 - F.col("n_warehouses")
    )
    warehouses = body.filter("k < 0").select(
        "file",
        (F.col("line_no") - 1).alias("warehouse_id"),
        F.get("n", F.lit(0)).cast("long").alias("capacity"),
        F.get("n", F.lit(1)).alias("opening_cost"),
    )
    clients = body.filter("k >= 0").withColumn("customer_id", F.expr("k div 2"))
    demands = clients.filter("k % 2 = 0").select(
        "file", "customer_id", F.get("n", F.lit(0)).cast("long").alias("demand")
    )
    costs = (
        clients.filter("k % 2 = 1")
        .select("file", "customer_id", F.posexplode("n").alias("pos", "cost"))
        .join(demands, ["file", "customer_id"])
        .select(
            "file",
            "customer_id",
            F.col("pos").cast("long").alias("warehouse_id"),
            (F.col("cost") / F.col("demand")).alias("unit_cost"),
        )
    )
    return warehouses, demands, costs


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``set NAME :=`` / ``param NAME :=`` blocks: (file, block, line_no, items, value).

    ``items`` are the quoted words of the line, ``value`` the whole number after ``]`` if any. A
    one-line ``param NAME := 5;`` gives a record without items. Each line belongs to the last block
    head above it.
    """
    lines = numbered_lines(spark, path)
    head = r"^(?:set|param) (\w+) :=\s*(\d*)"
    heads = lines.filter(F.col("text").rlike(head)).select(
        "file",
        F.col("line_no").alias("head_no"),
        F.regexp_extract("text", head, 1).alias("block"),
        F.regexp_extract("text", head, 2).alias("scalar"),
    )
    scalars = heads.filter("scalar != ''").select(
        "file",
        "block",
        F.col("head_no").alias("line_no"),
        F.array().cast("array<string>").alias("items"),
        F.col("scalar").cast("int").alias("value"),
    )
    # running block number per line instead of a range join
    marked = lines.withColumn("is_head", F.col("text").rlike(head).cast("long")).withColumn(
        "bucket", F.expr(f"line_no div {_BUCKET_LINES}")
    )
    in_block = bucketed_running_total(marked, ["file"], ["bucket"], ["line_no"], "is_head", "block_no")
    names = (
        in_block.filter("is_head = 1")
        .select("file", "block_no", F.regexp_extract("text", head, 1).alias("block"))
    )
    records = (
        in_block.filter("is_head = 0 AND text != ';'")
        .join(names, ["file", "block_no"])
        .select(
            "file",
            "block",
            "line_no",
            F.expr(r"regexp_extract_all(text, '\'([^\']+)\'', 1)").alias("items"),
            F.regexp_extract("text", r"\] (\d+)", 1).try_cast("int").alias("value"),
        )
    )
    return records.unionByName(scalars)
