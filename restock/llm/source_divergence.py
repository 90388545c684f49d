"""Audit of how far the sources of a language differ in their words.

Terms are counted per (language, source) by length-bucketed packing: terms of up to 8 bytes are one uint64, of up
to 16 bytes two, both radix-sorted 16 bits at a time and run-counted in numpy; longer terms go to a bucket of their
own that is sorted by bytes. Every language keeps the terms that at least ``least_docs`` of its documents hold. A
term with ``count`` occurrences in a group has the smoothed share p = 1 + floor(10^9 * (count + 1) / (N + V)), with V
kept terms and N occurrences of them in the group. The divergence of p from q is floor((p - q)^2 / q), in exact
integers.

* part ``pair``: from a source to each other source of its language, summed over all kept terms,
* part ``term``: the terms that a source uses more than its language, the ``top`` highest ones.

How it scales: a task sends one row for each (group, term) of its chunk of documents, which Spark sums; the hot
source is spread over tasks by that. Pairs of sources are compared in tiles of ``TILE`` x ``TILE`` sources and shards
of terms; terms that neither tile holds add the same amount each and are only counted. No task holds a language's
vocabulary or a group's rows.

A null text, language or source counts as ''. Every group that occurs has its pairs, also one without terms; a
language without kept terms has value 0 everywhere. Repeated rows count as documents of their own. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restock.llm.common import utf8_texts
from restock.session import cut_lineage, drop_staged

SCALE = 1_000_000_000
TILE = 64
SHARD_ROWS = 200_000
CHUNK_BYTES = 8 << 20
HELD_TERMS = 1_500_000

#: letters (A-Z lowered) and all bytes from 0x80 stay, everything else parts terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEEP = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

_SUMMED = pa.schema([("lang", pa.string())] + [(n, pa.int64()) for n in ("one", "other", "value", "terms")])


def radix_order(words: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """A stable order by the groups and then by the uint64 words, 16 bits at a time from the least."""
    order = np.arange(len(groups))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    low = (groups & 0xFFFF).astype(np.uint16)
    order = order[np.argsort(low[order], kind="stable")]
    if len(groups) and groups.max() > 0xFFFF:
        order = order[np.argsort(groups[order] >> 16, kind="stable")]
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Bucket:
    """Counted terms of ``width`` packed words, as sorted runs: groups, words, occurrences, documents."""

    def __init__(self, width: int):
        self.width = width
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, groups: np.ndarray, docs: np.ndarray, words: list[np.ndarray]) -> None:
        """Count a chunk's terms; documents are numbered in order."""
        order = radix_order(words, groups)
        groups, docs, words = groups[order], docs[order], [w[order] for w in words]
        new = _changes(groups, *words)
        first = np.flatnonzero(new)
        held = np.add.reduceat((new | _changes(docs)).astype(np.int64), first) if len(first) else first
        counts = np.diff(np.append(first, len(groups)))
        self.parts.append((groups[first], *(w[first] for w in words), counts, held))

    def rows(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        groups, words, sums = columns[0], columns[1 : 1 + self.width], columns[1 + self.width :]
        order = radix_order(words, groups)
        groups, words, sums = groups[order], [w[order] for w in words], [s[order] for s in sums]
        first = np.flatnonzero(_changes(groups, *words))
        self.parts = [(groups[first], *(w[first] for w in words), *(np.add.reduceat(s, first) for s in sums))]

    def take(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Groups, terms, occurrences, documents; the bucket is empty then."""
        self.merge()
        groups, *words, counts, docs = self.parts.pop()
        raw = np.stack(words, axis=1).astype(">u8").view(np.uint8)
        filled = raw != 0  # no term holds a zero byte
        offsets = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
        text = pa.py_buffer(raw[filled].tobytes())
        return groups, pa.StringArray.from_buffers(len(groups), pa.py_buffer(offsets.tobytes()), text), counts, docs


class LongBucket:
    """Terms of more than 16 bytes, sorted by bytes."""

    def __init__(self):
        self.parts: list[tuple[int, bytes, int, int]] = []

    def add(self, groups: np.ndarray, docs: np.ndarray, terms: list[bytes]) -> None:
        last, n, held, at = None, 0, 0, -1
        for group, term, doc in sorted(zip(groups.tolist(), terms, docs.tolist())):
            if (group, term) != last:
                if last:
                    self.parts.append((*last, n, held))
                last, n, held, at = (group, term), 0, 0, -1
            n += 1
            held += doc != at
            at = doc
        if last:
            self.parts.append((*last, n, held))

    def rows(self) -> int:
        return len(self.parts)

    def merge(self) -> None:
        merged: list[tuple[int, bytes, int, int]] = []
        for part in sorted(self.parts):
            if merged and merged[-1][:2] == part[:2]:
                merged[-1] = (*part[:2], merged[-1][2] + part[2], merged[-1][3] + part[3])
            else:
                merged.append(part)
        self.parts = merged

    def take(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        self.merge()
        groups, terms, counts, docs = zip(*self.parts)
        self.parts = []
        return np.array(groups, np.int64), pa.array(terms, pa.binary()).cast(pa.string()), np.array(counts), np.array(docs)


class TermCounter:
    """Counts of terms and of documents that hold them, per group number."""

    def __init__(self):
        self.buckets = [Bucket(1), Bucket(2), LongBucket()]
        self.merged = 0

    def add(self, texts: list[bytes], groups: np.ndarray) -> None:
        text = b" ".join(texts).translate(_LETTERS) + b" " * 16
        raw = np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(raw != 32, prepend=False))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        docs = np.searchsorted(ends, starts, side="right")
        at = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))  # the eight bytes from each place on
        of = groups[docs]
        for bucket, low, high in ((0, 1, 8), (1, 9, 16)):
            k = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(k):
                words = [at[starts[k]].astype(np.uint64)]
                if bucket:
                    words.append(at[starts[k] + 8].astype(np.uint64))
                words[-1] &= _KEEP[lengths[k] - low + 1]
                self.buckets[bucket].add(of[k], docs[k], words)
        k = np.flatnonzero(lengths > 16)
        if len(k):
            terms = [text[s : s + n] for s, n in zip(starts[k].tolist(), lengths[k].tolist())]
            self.buckets[2].add(of[k], docs[k], terms)

    def full(self) -> bool:
        """Whether more than HELD_TERMS rows are left after merging the chunks' counts."""
        if sum(b.rows() for b in self.buckets) < max(HELD_TERMS, 2 * self.merged):
            return False
        for b in self.buckets:
            b.merge()
        self.merged = sum(b.rows() for b in self.buckets)
        return self.merged >= HELD_TERMS

    def take(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        self.merged = 0
        return (b.take() for b in self.buckets if b.rows())


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n occurrences, docs that hold it; one row with an empty term for each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        counter = TermCounter()

        def rows() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            langs, sources = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))
            for groups, terms, counts, docs in counter.take():
                at = pa.array(groups)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(at), sources.take(at), terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTED
                )

        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            of = np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)
            texts, low, held = [], 0, 0
            for k, text in enumerate(utf8_texts(b.column(2))):
                texts.append(text)
                held += len(text)
                if held >= CHUNK_BYTES or k + 1 == b.num_rows:
                    counter.add(texts, of[low : k + 1])
                    texts, low, held = [], k + 1, 0
                    if counter.full():
                        yield from rows()
        yield from rows()
        if numbers:
            langs, sources = zip(*numbers)
            n = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((langs, sources, [""] * n, [0] * n, [0] * n), _COUNTED)], schema=_COUNTED
            )

    empty = F.lit("")
    texts = df.select(
        F.coalesce(F.col(lang_col), empty).alias("lang"),
        F.coalesce(F.col(source_col), empty).alias("source"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    )
    counted = texts.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """1 + floor(10^9 * (count + 1) / total) in longs, three digits at a time; SQL text."""
    high = f"(1000 * ({count} + 1)) div {total}"
    rest = f"(1000 * ({count} + 1)) % {total}"
    middle = f"(1000 * ({rest})) div {total}"
    low = f"(1000 * ((1000 * ({rest})) % {total})) div {total}"
    return f"1 + 1000000 * ({high}) + 1000 * ({middle}) + {low}"


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile_sums(table: pa.Table) -> pa.Table:
    """Sums over the terms of one shard that either tile of sources holds, for each pair of sources."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    number, share_of = table.column("number").to_numpy(), table.column("p").to_numpy()
    terms = pc.dictionary_encode(table.column("term").combine_chunks())
    valid = terms.is_valid().to_numpy(zero_copy_only=False)
    at = terms.indices.fill_null(0).to_numpy(zero_copy_only=False)
    n_terms = len(terms.dictionary)
    sides = {}
    for tile in {a, b}:
        mine = number // TILE == tile
        bare = mine & ~valid  # one row for each source: its share of a term that it does not hold
        grid = np.empty((int(number[bare].max()) % TILE + 1, n_terms), np.int64)
        grid[number[bare] % TILE] = share_of[bare][:, None]
        some = mine & valid
        grid[number[some] % TILE, at[some]] = share_of[some]
        sides[tile] = grid
    pairs = []
    for i, p in enumerate(sides[a]):
        for j, q in enumerate(sides[b]):
            if a != b or i != j:
                pairs.append((lang, a * TILE + i, b * TILE + j, int(divergence(p, q).sum()), n_terms))
    columns = zip(*pairs) if pairs else [()] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMMED)], schema=_SUMMED)


def divergences(
    df: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank: see the module. Stages its counts in the shared folder."""
    spark = df.sparkSession
    counted = cut_lineage(term_counts(df, lang_col, source_col, text_col))
    of_term = Window.partitionBy("lang", "term")
    kept = cut_lineage(
        counted.where("term <> ''")
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
        .where(F.col("lang_docs") >= least_docs)
        .select("lang", "source", "term", "n", "lang_n", "first")
    )
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    in_lang = Window.partitionBy("lang")
    groups = cut_lineage(
        counted.where("term = ''")
        .select("lang", "source")
        .join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
            F.greatest(F.coalesce("own_n", F.lit(0)) + F.coalesce("v", F.lit(0)), F.lit(1)).alias("total"),
            F.greatest(F.coalesce("all_n", F.lit(0)) + F.coalesce("v", F.lit(0)), F.lit(1)).alias("lang_total"),
        )
        .withColumn("number", F.row_number().over(in_lang.orderBy("source")).cast("long") - 1)
        .withColumn("tiles", F.floor((F.count("*").over(in_lang) - 1) / TILE) + 1)
        .withColumn("bare", F.expr(share("0", "total")))
    )
    drop_staged(spark, counted)
    held = kept.join(groups, ["lang", "source"])

    # each row meets all tiles of its language, as the one side and as the other
    shards = max(1, kept.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("term"), F.lit(shards))
    sides = (
        held.select("lang", "number", "tiles", "term", F.expr(share("n", "total")).alias("p"), F.array(shard).alias("shards"))
        .unionByName(
            groups.select(
                "lang", "number", "tiles", F.lit(None).cast("string").alias("term"), F.col("bare").alias("p"),
                F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")).alias("shards"),
            )
        )
        .withColumn("tile", F.expr(f"number div {TILE}"))
        .withColumn("tile2", F.explode(F.expr("sequence(0L, tiles - 1)")))
        .withColumn("way", F.explode(F.expr("if(tile = tile2, array(true), array(true, false))")))
        .select(
            "lang", F.when(F.col("way"), F.col("tile")).otherwise(F.col("tile2")).alias("a"),
            F.when(F.col("way"), F.col("tile2")).otherwise(F.col("tile")).alias("b"),
            F.explode("shards").alias("shard"), "number", "term", "p",
        )
    )
    summed = (
        sides.groupBy("lang", "a", "b", "shard")
        .applyInArrow(_tile_sums, "lang string, one long, other long, value long, terms long")
        .groupBy("lang", "one", "other")
        .agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    )
    one = groups.select("lang", F.col("number").alias("one"), "source", "v", F.col("bare").alias("p"))
    other = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"), F.col("bare").alias("q"))
    pairs = (
        summed.join(one, ["lang", "one"])
        .join(other, ["lang", "other"])
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                F.expr("value + (v - terms) * ((p - q) * (p - q) div q)").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = (
        held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    F.expr(share("n", "total")).alias("p"), F.expr(share("lang_n", "lang_total")).alias("q"))
        .where("p > q")
        .select("lang", "source", "part", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    return pairs.unionByName(terms)
