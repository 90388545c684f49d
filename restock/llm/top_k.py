"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are integers, their components play the part of terms. A shard holds document-range blocks
(ranges of the table in an order that puts vectors with the same strongest components side by
side) with each block's component maxima and minima and a forward index, that is its vectors row
by row. A query orders a shard's blocks by the sum of its component bounds and scores whole
blocks until the next bound falls below its k-th score. Every query block goes to every slot, and a
task reads a slot's shards and then its query blocks; nothing is joined, collected or broadcast.

Nulls: a null vector, or one with a null or non-finite component, takes no part, as query or as
candidate; neither does a row without id. An empty vector scores 0 with everything. A shorter
vector counts as padded with zeros. Rows that repeat an id and vector are candidates of their own;
a query does not meet rows of its own id, and a query id that occurs twice is one query (its
smallest vector, component by component). Ties go to the smaller id. An empty table gives no rows.
Scores must fit 64 bits; OverflowError otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restock.llm.common import batch
from restock.session import cut_lineage

BLOCK_ROWS = 64
SHARD_ROWS = 8192
QUERY_ROWS = 256

_VECTORS = pa.schema([("place", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])
#: Shards, and query blocks without bounds.
_PARTS = pa.schema(
    [("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("high", pa.binary()), ("low", pa.binary())]
)
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(place, id, dim, vector): floor(scale * component), and the sort place of each usable row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, ids, dims, vectors = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                values = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if len(v.values) else np.zeros(0)
                if not np.isfinite(values).all():
                    continue
                scaled = np.floor(scale * values)
                if len(scaled) and np.abs(scaled).max() >= 2.0**62:
                    raise OverflowError(f"vector {i}: a scaled component does not fit 64 bits")
                vector = scaled.astype("<i8")
                strong = np.argsort(-np.abs(vector), kind="stable")[:3]
                place = 0
                for s in strong:
                    place = place * 8192 + (2 * (int(s) % 4095) + int(vector[s] < 0)) + 1
                places.append(place)
                ids.append(i)
                dims.append(len(vector))
                vectors.append(vector.tobytes())
            yield batch(_VECTORS, (places, ids, dims, vectors))

    usable = df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).where(
        "i is not null and v is not null"
    )
    return usable.mapInArrow(convert, _ddl(_VECTORS))


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), "<i8")
    for k, row in enumerate(rows):
        out[k, : len(row) // 8] = np.frombuffer(row, "<i8")
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    rows: list[bytes] = []

    def flush() -> pa.RecordBatch:
        dim = max(map(len, rows)) // 8
        m = _matrix(rows, dim)
        starts = np.arange(0, len(rows), BLOCK_ROWS)
        high, low = np.maximum.reduceat(m, starts), np.minimum.reduceat(m, starts)
        values = ([len(rows)], [dim], [np.array(ids, "<i8").tobytes()], [m.tobytes()], [high.tobytes()], [low.tobytes()])
        ids.clear()
        rows.clear()
        return batch(_PARTS, values)

    for b in batches:
        for i, v in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            ids.append(i)
            rows.append(v)
            if len(rows) == SHARD_ROWS:
                yield flush()
    if rows:
        yield flush()


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, QUERY_ROWS):
            part = b.slice(start, QUERY_ROWS)
            dim = max(part.column(2).to_pylist(), default=0)
            m = _matrix(part.column(3).to_pylist(), dim)
            ids = np.array(part.column(1).to_pylist(), "<i8")
            yield batch(_PARTS, ([len(ids)], [dim], [ids.tobytes()], [m.tobytes()], [None], [None]))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where every partial sum is an exact whole number, 64-bit integers otherwise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most >= 2.0**63:
        raise OverflowError("inner products may not fit 64 bits")
    return np.float64 if most < 2.0**53 else np.int64


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, high: np.ndarray, low: np.ndarray, k: int):
    """The k best candidates of one shard for each query: lists of (query, candidate, score)."""
    dim = max(q.shape[1], m.shape[1])
    q, m, high, low = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, m, high, low))
    kind = _exact(q, m)
    q, m, high, low = (x.astype(kind) for x in (q, m, high, low))
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out_q, out_v, out_s = [], [], []
    for j in range(len(q)):
        order = np.argsort(-bounds[j], kind="stable")
        best_s, best_v = np.zeros(0, kind), np.zeros(0, np.int64)
        at, step = 0, 2
        while at < len(order):
            if len(best_s) == k and bounds[j, order[at]] < best_s[-1]:
                break  # an equal bound may still hold a tie with a smaller id
            take = order[at : at + step]
            rows = (take[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
            rows = rows[rows < len(ids)]
            rows = rows[ids[rows] != q_ids[j]]
            s = m[rows] @ q[j]
            if len(best_s) == k:
                near = s >= best_s[-1]
                s, rows = s[near], rows[near]
            s, v = np.concatenate([best_s, s]), np.concatenate([best_v, ids[rows]])
            if len(s) > 4 * k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, v = s[keep], v[keep]
            top = np.lexsort((v, -s))[:k]
            best_s, best_v = s[top], v[top]
            at += step
            step = min(2 * step, 32)
        out_q.append(np.full(len(best_v), q_ids[j]))
        out_v.append(best_v)
        out_s.append(best_s.astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s)


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024
) -> DataFrame:
    """The ``k`` largest inner products of every query row against all other rows.

    Returns query_id, rank (from 1), vec_id, score.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, shards = None, []
        for row in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            if row["slot"] != slot:
                slot, shards = row["slot"], []
            dim, n = row["dim"], row["n"]
            read = lambda name, rows: np.frombuffer(row[name], "<i8").reshape(rows, dim)  # noqa: B023, E731
            ids, m = np.frombuffer(row["ids"], "<i8"), read("matrix", n)
            if row["high"] is not None:
                shards.append((ids, m, *(read(x, -(-n // BLOCK_ROWS)) for x in ("high", "low"))))
                continue
            for shard in shards:
                yield batch(_HITS, search_shard(ids, m, *shard, k))

    vectors = cut_lineage(integer_vectors(df, id_col, vector_col, scale))
    n = vectors.count()
    slots = max(1, -(-n // SHARD_ROWS))
    # the id spreads vectors with the same place (equal ones, too) over neighbouring ranges
    ordered = vectors.repartitionByRange(slots, "place", "id").sortWithinPartitions("place", "id")
    # the first shard of a range has a slot of its own, more of them (of equal rows, too) go to the next slots
    row = F.monotonically_increasing_id()
    slot = F.pmod(F.shiftright(row, 33) + F.pmod(row, F.lit(1 << 33)), F.lit(slots))
    shards = cut_lineage(ordered.mapInArrow(_shards, _ddl(_PARTS)).withColumn("slot", slot))
    wanted = df.select(F.col(id_col).cast("long").alias("id")).where(is_query).distinct()
    queries = vectors.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("vector", "dim")).alias("v"))
    n_queries = queries.count()
    blocks = (
        queries.select(F.lit(0).cast("long").alias("place"), "id", "v.dim", "v.vector")
        .repartition(max(1, -(-n_queries // QUERY_ROWS)), "id")
        .mapInArrow(_query_blocks, _ddl(_PARTS))
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    )
    # not a join: its size is guessed without the explode, so all copies of the blocks were broadcast
    parts = shards.unionByName(blocks).repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", F.col("high").isNull())
    hits = parts.mapInArrow(find, _ddl(_HITS))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
