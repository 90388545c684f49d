"""Table sources and sinks: dated landing zone, parquet, CSV, SQL text, literal rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def landing_path(root: str, timestamp: str, table: str) -> str:
    return f"{root.rstrip('/')}/{timestamp}/{table}.parquet"


def read_landing(spark: SparkSession, root: str, timestamp: str, table: str) -> DataFrame:
    """One table of one landing batch; only that batch's folder is listed."""
    return spark.read.parquet(landing_path(root, timestamp, table))


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "zstd",
    partition_by: Iterable[str] = (),
    mode: str = "overwrite",
) -> str:
    writer = df.write.mode(mode).option("compression", compression)
    partition_by = list(partition_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def scan_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True
) -> DataFrame:
    """CSV with a declared schema, so no pass is spent on guessing types."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text over the given tables, written ``{name}`` in the text."""
    return spark.sql(text, **tables)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
