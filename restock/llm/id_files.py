"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A set of files is a folder with ``header`` (one row: the code length of every id) and ``blocks``. A
block holds whole documents with at least ``BLOCK_IDS`` ids (the last one of a file may hold fewer):
their ids and lengths, the bits of their codes, and the bit offset of every ``STEP``-th id. Blocks need
only the header, so any task can decode any block; inside a batch of blocks all runs between
checkpoints are decoded side by side with one table look-up per id.

Spark's Parquet writer carries the blocks, so a lost executor leaves no half file and any store works.
Files are in ascending document order (nulls first, repeated ids by content). A null or empty text has
the end id only. An empty table gives a header without codes and no blocks. Code lengths come from the
counts of all ids; the table of counts has one row per vocabulary entry, which bounds what is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.llm.common import batch, once_per_process, ragged, utf8_texts
from restock.llm.word_ids import word_ids
from restock.session import cut_lineage

BLOCK_IDS = 1 << 16
STEP = 256
MAX_BITS = 18
FILE_IDS = 8_000_000

_TOKENS = pa.schema(
    [("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())]
)
_BLOCKS = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n", pa.int64())]
    + [(name, pa.binary()) for name in ("known", "doc_ids", "doc_sizes", "bits", "checkpoints")]
)
_DOCS = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package merge); 0 for counts of 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)  # sums of packages may pass 64 bits
    level, leaves = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([coins, pairs])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        leaves.append(order < n)
    chosen = 2 * n - 2
    for flags in reversed(leaves):
        taken = int(flags[:chosen].sum())
        lengths[used[:taken]] += 1
        chosen = 2 * (chosen - taken)
    return lengths


class Codes:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        order = np.argsort(self.lengths, kind="stable")
        order = order[self.lengths[order] > 0]
        spans = 1 << (self.width - self.lengths[order])
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (self.width - self.lengths[order])
        self.symbols = np.zeros(1 << self.width, np.uint32)  # by the next ``width`` bits
        self.steps = np.zeros(1 << self.width, np.uint8)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(order, spans)
        self.steps[:filled] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, most significant first, in 64-bit words; bit offsets of every STEP-th id."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 2, np.uint64)
        word, free = starts >> 6, 64 - (starts & 63) - sizes
        codes = self.codes[ids]
        fits = free >= 0
        high = np.where(fits, codes << np.maximum(free, 0).astype(np.uint64), codes >> np.maximum(-free, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] = np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(~fits)
            words[word[over] + 1] |= codes[over] << (64 + free[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), starts[::STEP]

    def decode(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Runs of ``sizes`` ids from bit offsets ``starts``, all runs step by step side by side."""
        out = np.zeros((STEP, len(starts)), np.uint32)
        at = starts.astype(np.int64)
        shift = np.uint64(64 - self.width)
        order = np.argsort(-sizes, kind="stable")
        at = at[order]
        active = np.searchsorted(-sizes[order], -np.arange(STEP), "left")  # runs with more than t ids
        for t in range(int(sizes.max(initial=0))):
            n = active[t]
            word, off = at[:n] >> 6, (at[:n] & 63).astype(np.uint64)
            window = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
            key = window >> shift
            out[t, :n] = self.symbols[key]
            at[:n] += self.steps[key]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        run, place = ragged(sizes)
        return out[place, back[run]]


def tokenise(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, n, ids, counts): the ids of each document, in 16 bits where they fit, else in 32.

    The first byte tells the width. Each batch adds a row with only the counts of its ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for b in batches:
            texts = list(utf8_texts(b.column(1)))
            for lo in range(0, len(texts), 1000):
                ids = [np.append(x, end_id).astype("<u4") for x in encoder.encode(texts[lo : lo + 1000])]
                raw = [b"\2" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\4" + x.tobytes() for x in ids]
                k = len(raw)
                counts = np.bincount(np.concatenate(ids))
                used = np.flatnonzero(counts)
                counted = np.concatenate([used, counts[used]]).astype("<i8").tobytes()
                yield batch(_TOKENS, (
                    pa.concat_arrays([b.column(0).slice(lo, 1000), pa.nulls(1, pa.int64())]),
                    [zlib.crc32(x) for x in raw] + [None], [len(x) for x in ids] + [None], raw + [None], [None] * k + [counted],
                ))

    ddl = "doc_id long, tie long, n long, ids binary, counts binary"
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, ddl)


def _ids(raw: pa.Scalar) -> np.ndarray:
    view = memoryview(raw.as_buffer())
    return np.frombuffer(view[1:], f"<u{view[0]}").astype("<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column(0):
            used, counts = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
            if used[-1] >= len(total):
                total = np.concatenate([total, np.zeros(used[-1] + 1 - len(total), np.int64)])
            total[used] += counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def write_ids(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 1, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all documents of ``df`` into files below ``path``, in ascending document order."""
    spark = df.sparkSession
    staged = cut_lineage(tokenise(df, tokenizer, end_id, id_col, text_col))
    tokens = staged.where("n is not null").drop("counts")
    counted = staged.select("counts").where("counts is not null").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    header = spark.createDataFrame([(bytearray(lengths.tobytes()), int(counts.sum()))], "lengths binary, n long")
    header.coalesce(1).write.parquet(f"{path}/header")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        part, block, before, size = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, size
            bits, checkpoints = codes.encode(np.concatenate(held))
            known = np.array([d is not None for d in doc_ids], np.uint8)
            names = np.array([d or 0 for d in doc_ids], "<i8")
            row = batch(_BLOCKS, (
                [part], [block], [before], [size], [known.tobytes()], [names.tobytes()],
                [np.array([len(x) for x in held], "<i8").tobytes()], [bits], [checkpoints.astype("<i8").tobytes()],
            ))
            block, before, size = block + 1, before + size, 0
            doc_ids.clear()
            held.clear()
            return row

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids.append(doc_id)
                held.append(_ids(ids))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    ordered = tokens.repartitionByRange(files, F.asc_nulls_first("doc_id"), "tie")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").select("doc_id", "ids")
    ddl = "part int, block int, before long, n long, known binary, doc_ids binary, doc_sizes binary, bits binary, checkpoints binary"
    ordered.mapInArrow(blocks, ddl).write.parquet(f"{path}/blocks")


def _decode_rows(codes: Codes, rows: list[dict], first: dict[int, int]) -> pa.RecordBatch:
    payloads = [np.frombuffer(r["bits"], ">u8") for r in rows]
    base = np.cumsum([0] + [len(p) for p in payloads])
    words = np.concatenate([*payloads, np.zeros(2, ">u8")]).astype(np.uint64)
    starts, sizes = [], []
    for r, b in zip(rows, base):
        points = np.frombuffer(r["checkpoints"], "<i8")
        starts.append(points + 64 * b)
        sizes.append(np.minimum(STEP, r["n"] - STEP * np.arange(len(points))))
    ids = codes.decode(words, np.concatenate(starts), np.concatenate(sizes)).astype("<u4")
    at, out = 0, []
    for r in rows:
        place = first[r["part"]] + r["before"]
        known = np.frombuffer(r["known"], np.uint8)
        for k, d, n in zip(known, np.frombuffer(r["doc_ids"], "<i8").tolist(), np.frombuffer(r["doc_sizes"], "<i8").tolist()):
            out.append((d if k else None, place, n, zlib.crc32(ids[at : at + n])))
            at, place = at + n, place + n
    return batch(_DOCS, zip(*out))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files below ``path``: doc_id, start, n_tokens, ids_crc32 of every document."""
    header = spark.read.parquet(f"{path}/header").first()
    lengths = np.frombuffer(bytes(header.lengths), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number a file
    first, total = {}, 0
    for part in sorted(sizes):
        first[part] = total
        total += sizes[part]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = once_per_process("codes", path, lambda: Codes(lengths))
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield _decode_rows(codes, b.slice(lo, 64).to_pylist(), first)

    return blocks.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
