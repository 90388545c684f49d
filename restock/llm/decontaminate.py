"""Benchmark decontamination with suffix arrays over the training documents.

The documents of a task are cut into shards of about SHARD_WORDS words. A shard's suffix array orders
all its word suffixes (by their first ``depth`` words; prefix doubling re-sorts only what is still
tied). Every benchmark suffix is found by binary search in every shard: the suffixes that share its
first ``window`` words are one range, whose members are the verbatim occurrences. Occurrences that overlap or meet
are one span, so a span covers the longest matches in its place; :func:`longest_matches` extends each benchmark
suffix word by word and returns its longest match. A document with any occurrence is affected.

The benchmark is a stated query set: it meets the shards in chunks of at most ``chunk_bytes`` of
text (one item at least), each sent to all executors once. Documents are never gathered.

Words are maximal runs of digits, ASCII letters (lower-cased) and characters from U+0080 on. A null or
empty text has no words and no hits; an item without words occurs nowhere; an item shorter than the
window counts as one window. Repeated item ids count once, a null item id is written as an empty
string. Repeated documents are searched row by row. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import ragged, release, utf8_texts, with_rows
from restock.session import cut_lineage

SHARD_WORDS = 1_500_000
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def split_words(utf8: bytes) -> list[bytes]:
    return utf8.translate(_FOLD).split()


class Numbers(dict):
    """Numbers words from 1 in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


@dataclass
class Windows:
    """Distinct benchmark windows as stretches of word numbers, and the items that hold each of them."""

    vocabulary: list[bytes]  # the word of each number
    words: np.ndarray  # numbers of all items' words, end to end
    starts: np.ndarray
    lengths: np.ndarray
    items: list[str]
    held_by: np.ndarray  # places in ``items``, window by window
    held_from: np.ndarray  # where a window's begin in ``held_by``; one more entry than windows

    def plain(self) -> tuple:
        """What is sent to executors: no class of this module, so that a worker need not import it."""
        return tuple(self.__dict__.values())

    def holders(self, window: int) -> list[str]:
        return [self.items[k] for k in self.held_by[self.held_from[window] : self.held_from[window + 1]]]


def benchmark_windows(rows: list[tuple[str, bytes]], window: int) -> Windows:
    numbers, items = Numbers(), Numbers()
    words: list[np.ndarray] = []
    starts: list[int] = []
    lengths: list[int] = []
    known: dict[bytes, int] = {}
    held: list[tuple[int, int]] = []
    at = 0
    for item, text in rows:
        found = split_words(text)
        mine = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)) - 1
        for k in range(max(1, len(mine) - window + 1) if len(mine) else 0):
            key = mine[k : k + window].tobytes()
            number = known.setdefault(key, len(known))
            if number == len(starts):
                starts.append(at + k)
                lengths.append(len(key) // 4)
            held.append((number, items[item] - 1))
        words.append(mine)
        at += len(mine)
    pairs = np.unique(np.array(held, np.int64).reshape(-1, 2), axis=0)
    return Windows(
        list(numbers), np.concatenate([np.zeros(0, np.int32), *words]), np.array(starts, np.int64), np.array(lengths, np.int64),
        list(items), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1)),
    )


class SuffixArray:
    """Suffixes of a shard, 0 behind every document; ``left`` is the number of words to its end."""

    def __init__(self, documents: list[np.ndarray], numbers: Numbers, depth: int):
        """``documents``: word numbers; ``numbers``: what they stand for."""
        self.numbers = numbers
        lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        n = int((lengths + 1).sum())
        words = np.zeros(n + depth + 1, np.int32)
        for start, d in zip(self.starts, documents):
            words[start : start + len(d)] = d
        self.words = words
        run, place = ragged(lengths + 1)
        self.left = (lengths[run] - place).astype(np.int32)
        self._sort(n, depth)

    def _sort(self, n: int, depth: int) -> None:
        bits = max(1, int(len(self.numbers) + 1).bit_length())
        self.bits, self.packed = bits, max(1, min(63 // bits, depth))
        at = np.flatnonzero(self.left > 0)
        key = self.pack(self.words, at, self.left[at])
        order = np.argsort(key)
        sa, key = at[order], key[order]
        self.keys = key
        first = np.empty(len(sa), bool)
        if len(sa):
            first[0], first[1:] = True, key[1:] != key[:-1]
        rank = np.zeros(n + depth + 1, np.int64)  # 0: past the end; else 1 + slot of the group's first
        slot = np.flatnonzero(first)
        group = np.repeat(slot, np.diff(np.append(slot, len(sa))))
        rank[sa] = group + 1
        cover = self.packed
        open_ = np.flatnonzero(np.repeat(np.diff(np.append(slot, len(sa))) > 1, np.diff(np.append(slot, len(sa)))))
        while cover < depth and len(open_):
            here = sa[open_]
            beyond = np.where(self.left[here] > cover, rank[np.minimum(here + cover, n)], 0)
            mine = group[open_]
            order = np.argsort((mine << 32) | beyond)
            here, beyond = here[order], beyond[order]
            sa[open_] = here
            new = np.empty(len(here), bool)
            new[0], new[1:] = True, (mine[1:] != mine[:-1]) | (beyond[1:] != beyond[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(here)))
            group[open_] = np.repeat(open_[starts], sizes)
            rank[here] = group[open_] + 1
            open_ = open_[np.repeat(sizes > 1, sizes)]
            cover *= 2
        self.sa = sa

    def pack(self, words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for t in range(self.packed):
            key = (key << self.bits) | np.where(left > t, words[at + t], 0)
        return key

    def ranges(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows whose words all occur, and their half-open ranges of the suffix array."""
        here = np.fromiter((self.numbers.get(w, 0) for w in windows.vocabulary), np.int32, len(windows.vocabulary))
        grid = np.zeros((len(windows.starts), int(windows.lengths.max(initial=0)) + self.packed), np.int32)
        whole = np.ones(len(grid), bool)
        for t in range(int(windows.lengths.max(initial=0))):
            inside = np.flatnonzero(windows.lengths > t)
            grid[inside, t] = here[windows.words[windows.starts[inside] + t]]
            whole[inside] &= grid[inside, t] > 0
        known = np.flatnonzero(whole)
        grid, lengths = grid[known], windows.lengths[known]
        low_key, high_key = np.zeros((2, len(known)), np.int64)
        for t in range(self.packed):
            inside = lengths > t
            low_key = (low_key << self.bits) | np.where(inside, grid[:, t], 0)
            high_key = (high_key << self.bits) | np.where(inside, grid[:, t], (1 << self.bits) - 1)
        lo = np.searchsorted(self.keys, low_key, "left")
        hi = np.searchsorted(self.keys, high_key, "right")
        return known, self._bound(grid, lengths, lo, hi, False), self._bound(grid, lengths, lo, hi, True)

    def _bound(self, grid: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) // 2
            at = self.sa[mid]
            sign = np.zeros(len(active), np.int8)
            alive = np.arange(len(active))
            for t in range(self.packed, grid.shape[1]):
                alive = alive[(sign[alive] == 0) & (lengths[active[alive]] > t)]
                if not len(alive):
                    break
                sign[alive] = np.sign(self.words[at[alive] + t] - grid[active[alive], t])
            right = sign < 0 if not upper else sign <= 0
            lo[active[right]] = mid[right] + 1
            hi[active[~right]] = mid[~right]
        return lo


def occurrences(array: SuffixArray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, length) of every verbatim occurrence of a window in the shard."""
    known, lo, hi = array.ranges(windows)
    run, offset = ragged(hi - lo)
    places = array.sa[lo[run] + offset]
    return known[run], places, windows.lengths[known][run]


def _search(documents: list[np.ndarray], numbers: Numbers, windows: Windows, depth: int):
    """Per document: hit spans (in words) and the items that occur."""
    array = SuffixArray(documents, numbers, depth)
    which, place, length = occurrences(array, windows)
    steps = np.zeros(len(array.left) + 1, np.int32)
    np.add.at(steps, place, 1)
    np.add.at(steps, place + length, -1)
    hit = np.cumsum(steps) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    owner = np.searchsorted(array.starts, begin, "right") - 1
    spans: list[list] = [[] for _ in documents]
    for d, s, e in zip(owner.tolist(), (begin - array.starts[owner]).tolist(), (end - array.starts[owner]).tolist()):
        spans[d].append((s, e))
    items: list[set] = [set() for _ in documents]
    owner = np.searchsorted(array.starts, place, "right") - 1
    for d, w in np.unique(np.stack([owner, which]), axis=1).T.tolist() if len(which) else []:
        items[d].update(windows.holders(w))
    return spans, items


_HITS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_HITS_DDL = "row long, doc_id long, n_words long, spans array<struct<s: long, e: long>>, items array<string>"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[np.ndarray], Numbers]]:
    """Rows, ids, documents as word numbers, and the numbers of the words, shard by shard."""
    rows, ids, documents, numbers, size = [], [], [], Numbers(), 0
    for b in batches:
        for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8_texts(b.column(2))):
            words = split_words(text)
            rows.append(row)
            ids.append(doc_id)
            documents.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= SHARD_WORDS:
                yield rows, ids, documents, numbers
                rows, ids, documents, numbers, size = [], [], [], Numbers(), 0
    if rows:
        yield rows, ids, documents, numbers


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in parts whose texts have ``chunk_bytes`` together, up to the spread of a hash."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // chunk_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).where("t is not null").collect()
        yield [(r.i, r.t.encode()) for r in part]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, depth: int = 16, chunk_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document row: row, doc_id, n_words, the hit spans in words, and the items found.

    ``row`` is monotonically_increasing_id() over ``docs``.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )

    def against(windows: Windows) -> DataFrame:
        sent = spark.sparkContext.broadcast(windows.plain())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for rows, ids, documents, numbers in _shards(batches):
                spans, items = _search(documents, numbers, Windows(*sent.value), max(depth, window))
                columns = (rows, ids, [len(d) for d in documents], [[{"s": s, "e": e} for s, e in x] for x in spans], [sorted(x) for x in items])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS)], schema=_HITS)

        return source.mapInArrow(work, _HITS_DDL)

    chunks = _chunks(benchmark, item_col, item_text_col, chunk_bytes)
    ahead = next(chunks, [])
    found = None
    while ahead is not None:  # one chunk's windows at a time
        windows, ahead = benchmark_windows(ahead, window), next(chunks, None)
        if found is None and ahead is None:
            return against(windows)
        one = cut_lineage(against(windows))
        found = one if found is None else found.union(one)
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return find_hits(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_affected(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    numbered, row = with_rows(docs)
    hit = cut_lineage(find_hits(docs, benchmark, **options).where(F.size("spans") > 0).select(F.col("row").alias(row)))
    return numbered.join(hit, row, "left_anti").drop(row)


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, depth: int = 16, chunk_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """For every benchmark suffix that occurs with ``window`` words or more: its longest verbatim match.

    Returns item_id, item_pos, length (words), doc_id, doc_pos; ties go to the smallest place.
    """
    spark = docs.sparkSession
    source = docs.select(F.lit(0).cast("long"), F.col(id_col).cast("long"), F.col(text_col))
    out = pa.schema([("item_id", pa.string())] + [(n, pa.int64()) for n in ("item_pos", "length", "doc_id", "doc_pos")])

    def against(rows: list[tuple[str, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast([(i, w) for i, t in rows if (w := split_words(t))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            suffixes = [(k, p) for k, (_, w) in enumerate(sent.value) for p in range(max(1, len(w) - window + 1))]
            numbers, starts = Numbers(), np.cumsum([0, *(len(w) for _, w in sent.value)])
            words = np.array([numbers[x] - 1 for _, w in sent.value for x in w], np.int32)
            at = np.array([starts[k] + p for k, p in suffixes], np.int64)
            sizes = np.array([min(window, len(sent.value[k][1]) - p) for k, p in suffixes], np.int64)
            none = np.zeros(0, np.int64)
            windows = Windows(list(numbers), words, at, sizes, [], none, none)
            for _, ids, documents, numbers in _shards(batches):
                array = SuffixArray(documents, numbers, max(depth, window))
                which, place, length = occurrences(array, windows)
                best: dict[int, tuple[int, int]] = {}
                for s, at, n in zip(which.tolist(), place.tolist(), length.tolist()):
                    k, p = suffixes[s]
                    words = sent.value[k][1]
                    while p + n < len(words) and array.words[at + n] and array.words[at + n] == array.numbers.get(words[p + n], -1):
                        n += 1
                    best[s] = max(best.get(s, (0, 0)), (n, -at))
                rows_out = []
                for s, (n, at) in best.items():
                    d = int(np.searchsorted(array.starts, -at, "right")) - 1
                    rows_out.append((sent.value[suffixes[s][0]][0], suffixes[s][1], n, ids[d], -at - int(array.starts[d])))
                columns = list(zip(*rows_out)) or [[]] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        return source.mapInArrow(work, "item_id string, item_pos long, length long, doc_id long, doc_pos long")

    found = None
    for chunk in _chunks(benchmark, item_col, item_text_col, chunk_bytes):
        found = against(chunk) if found is None else found.union(against(chunk))
    if found is None:
        found = spark.createDataFrame([], "item_id string, item_pos long, length long, doc_id long, doc_pos long")
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_pos")).alias("b")
    return found.groupBy("item_id", "item_pos").agg(best).select(
        "item_id", "item_pos", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_pos"
    )
