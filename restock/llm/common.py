"""Small helpers shared by the operators: table access, Arrow columns, per-process caches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def once_per_process(kind: str, version: str, make: Callable[[], object]) -> object:
    """``make()`` once in each Python worker, shared by all tasks that it runs.

    A worker keeps the last one only, so that workers which live through many stages do not fill up.
    """
    store = sys.modules.setdefault("_restock_llm_store", types.ModuleType("_restock_llm_store")).__dict__
    held = store.get("held")
    if held is None or held[0] != (kind, version):
        release()
        held = store["held"] = ((kind, version), make())
    return held[1]


def release() -> None:
    """Give up what tasks of an earlier stage cached in this worker, and hand freed memory back."""
    store = sys.modules.get("_restock_llm_store")
    if store is not None:
        store.__dict__["held"] = None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def utf8_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty. No Python string is made."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_binary(array.type) and not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary())
    for value in array:
        yield value.as_py() or b""


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run of each element and its place in that run."""
    lengths = np.asarray(lengths, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - starts[run]


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` and the name of a new column with monotonically_increasing_id()."""
    name = free_name(df, "_row")
    return df.withColumn(name, F.monotonically_increasing_id()), name
