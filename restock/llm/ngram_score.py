"""Scores of documents under an n-gram model in Elias-Fano tries.

The model: P(w | u) = c(uw) / (c(u) + K) + K / (c(u) + K) * P(w), with P(w) = (c(w) + 1) / (N + V + 1). Level 1
of the trie holds the contexts u, level 2 their successors w. Both levels are Elias-Fano coded monotone
sequences, so are the pointers from a context to its successors; a successor is stored relative to its
context (context number x words of the shard + word number). Next to each successor lies its smoothed
probability c(uw) / (c(u) + K), quantised to 16 bits on a log scale. A query finds the context, and then the
successor in the context's range. Levels are memory-mapped from an unlinked file while a shard is queried.

The model is never in one place. Documents are cut into blocks of about BLOCK_TOKENS tokens. A block
sends its distinct words and word pairs, with their training counts, once to the shards that own
them (by hash); a shard adds up the counts, builds its trie and answers all blocks; each block then adds
up its documents. Contexts that are a large part of all tokens are spread over the shards by their
successor. Words are known by 64-bit hashes, successors of one context by 48 bits of them.

Tokens are the words between white space (ASCII, A-Z lower-cased) and one end. A null or empty text is the
end only. Repeated rows are counted and scored row by row; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, utf8_texts
from restock.session import cut_lineage

BLOCK_TOKENS = 2_000_000
SHARD_PAIRS = 2_000_000
SHARD_WORDS = 1_000_000
WEIGHT = 20.0
STEPS = 4096  # quantisation steps of one power of ten
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_START, _END = np.uint64(1), np.uint64(2)  # hashes set aside for the marks around a text

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _BITS.sum(1).astype(np.int64)
_PLACE = np.zeros((256, 8), np.int64)  # place of the k-th set bit of a byte
for _byte in range(256):
    _set = np.flatnonzero(_BITS[_byte])
    _PLACE[_byte, : len(_set)] = _set


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: packed low bits, unary high bits."""

    def __init__(self, parts: tuple[int, int, np.ndarray, np.ndarray, np.ndarray]):
        self.n, self.low_bits, self.low, self.high, self.zeros = parts

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(16, np.uint8)])
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (top >> low_bits) + n + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        # zeros before each run of 8 bytes, to find the k-th zero
        zeros = np.concatenate([[0], np.cumsum(64 - _COUNT[high].reshape(-1, 8).sum(1))])
        return n, low_bits, packed, high, zeros

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        run = np.searchsorted(self.zeros, k, "right") - 1
        run = np.minimum(run, len(self.zeros) - 2)
        left = k - self.zeros[run]
        out = np.zeros(len(k), np.int64)
        todo = np.arange(len(k))
        for b in range(8):
            byte = ~self.high[8 * run[todo] + b]
            have = _COUNT[byte]
            here = left[todo] < have
            at = todo[here]
            out[at] = 64 * run[at] + 8 * b + _PLACE[byte[here], left[at]]
            todo = todo[~here]
            left[todo] -= have[~here]
            if not len(todo):
                break
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        at, off = bit >> 3, (bit & 7).astype(np.uint64)
        value = self._window(at) >> off
        if self.low_bits > 56:  # the rest of a value that starts inside a byte
            value |= np.where(off > 0, self.low[at + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return value & np.uint64((1 << self.low_bits) - 1)

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes from each place of the low bits."""
        return np.ndarray((len(self.low) - 8,), "<u8", self.low, strides=(1,))[at]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The number of each value in the sequence, -1 if it is not there."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        inside = np.flatnonzero(high <= last)
        high = high[inside]
        lo = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        hi = np.minimum(self._zero(high) - high, self.n)
        wanted = values[inside] & np.uint64((1 << self.low_bits) - 1)
        end = hi.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) // 2
            less = self._low(mid) < wanted[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
        ok = np.flatnonzero(lo < end)
        ok = ok[self._low(lo[ok]) == wanted[ok]]
        out[inside[ok]] = lo[ok]
        return out

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values number ``i`` (for short sequences and tests)."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones[i] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes from 1; 0 is left for pairs that are not in the trie."""
    return np.clip(np.rint(-np.log10(p) * STEPS) + 1, 1, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) / STEPS), 0.0)


class Trie:
    """Contexts, pointers and successors of one shard, mapped from an unlinked file."""

    def __init__(self, u: np.ndarray, w: np.ndarray, p: np.ndarray):
        """Distinct pairs sorted by (u, w) with their probabilities."""
        contexts, start = np.unique(u, return_index=True)
        words = np.unique(w)
        number = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(u))))
        relative = number.astype(np.uint64) * np.uint64(len(words)) + np.searchsorted(words, w).astype(np.uint64)
        pointers = np.append(start, len(u)).astype(np.uint64)
        self.words_n = np.uint64(len(words))
        self.pointers_raw = pointers
        levels = [EliasFano.encode(x) for x in (contexts, words, relative, pointers)]
        arrays = [a for level in levels for a in level[2:]] + [quantise(p)]
        with tempfile.TemporaryFile() as out:  # has no name, so nothing stays behind
            places = []
            for a in arrays:
                out.write(b"\0" * (-out.tell() % 8))
                places.append(out.tell())
                out.write(a.tobytes())
            out.write(b"\0" * 8)
            out.flush()
            self.file = mmap.mmap(out.fileno(), 0, access=mmap.ACCESS_READ)
        read = [np.frombuffer(self.file, a.dtype, len(a), at) for a, at in zip(arrays, places)]
        self.contexts, self.words, self.successors, self.pointers = (
            EliasFano((levels[k][0], levels[k][1], *read[3 * k : 3 * k + 3])) for k in range(4)
        )
        self.codes = read[12]

    def bytes(self) -> int:
        return len(self.file)

    def query(self, u: np.ndarray, runs: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes of the pairs: distinct contexts, the number of words of each, and the words."""
        context = np.repeat(self.contexts.find(u), runs)
        word = self.words.find(w)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        relative = context[known].astype(np.uint64) * self.words_n + word[known].astype(np.uint64)
        found = self.successors.find(relative)
        codes = np.zeros(len(w), np.uint16)
        hit = found >= 0
        codes[known[hit]] = self.codes[found[hit]]
        return codes


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _read(raw, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _short(words: np.ndarray) -> np.ndarray:
    """The low 48 bits of hashes, in 6 bytes."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _read_short(raw) -> np.ndarray:
    short = _read(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([short, np.zeros((len(short), 2), np.uint8)], axis=1).view("<u8").ravel()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = max(xxhash.xxh3_64_intdigest(word), 3)  # 0 to 2 are set aside
        return value


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("tokens", pa.int64()), ("train_tokens", pa.int64()), ("train_docs", pa.int64()), ("words", pa.int64())]
    + [(n, pa.binary()) for n in ("ids", "known", "held", "lengths", "hashes", "counts", "stream")]
)
_BLOCKS_DDL = "block long, tokens long, train_tokens long, train_docs long, words long, " + ", ".join(f"{f.name} binary" for f in list(_BLOCKS)[5:])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = TaskContext.get().partitionId() << 32
    hashes = Hashes()
    ids: list[int | None] = []
    held: list[bool] = []
    streams: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal serial, size
        lengths = np.array([len(s) for s in streams], np.int32)
        words, inverse = np.unique(np.concatenate(streams), return_inverse=True)
        train = np.repeat(~np.array(held), lengths)
        counts = np.bincount(inverse[train], minlength=len(words))
        # frequent words first: small numbers pack better
        order = np.argsort(-np.bincount(inverse, minlength=len(words)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        columns = (
            [serial], [int(lengths.sum())], [int(train.sum())], [len(held) - sum(held)], [len(words)],
            [_pack(np.array([i or 0 for i in ids], "<i8"))], [_pack(np.array([i is not None for i in ids], np.uint8))],
            [_pack(np.array(held, np.uint8))], [_pack(lengths)], [_pack(words[order])], [_pack(counts[order].astype("<i4"))], [_pack(place[inverse])],
        )
        serial, size = serial + 1, 0
        for x in (ids, held, streams):
            x.clear()
        return batch(_BLOCKS, columns)

    for b in batches:
        for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8_texts(b.column(2))):
            words = text.translate(_LOWER).split()
            stream = np.empty(len(words) + 1, np.uint64)
            stream[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            stream[-1] = _END
            ids.append(doc_id)
            held.append(bool(out))
            streams.append(stream)
            size += len(stream)
            if size >= BLOCK_TOKENS:
                yield flush()
                if len(hashes) > 1_000_000:
                    hashes.clear()
    if ids:
        yield flush()


def _split(owner: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that occurs, in their order."""
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(shards + 1))
    for s in range(shards):
        if bounds[s] < bounds[s + 1]:
            yield s, order[bounds[s] : bounds[s + 1]]


def _owner(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


_WORD_ROWS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary()), ("distinct", pa.int64()), ("frequent", pa.binary())])
_ANSWERS_DDL = "block long, shard long, answer binary, distinct long, frequent binary"


def _word_answers(table: pa.Table, often: int) -> pa.Table:
    """Counts of a shard's words over all blocks, for each block that asked."""
    blocks = table.column("block").to_pylist()
    keys = [_read(x.as_buffer(), "<u8") for x in table.column("hashes")]
    counts = [_read(x.as_buffer(), "<i4") for x in table.column("counts")]
    words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(words)).astype("<i8")
    at, answers = 0, []
    for k in keys:
        answers.append(_pack(total[inverse[at : at + len(k)]]))
        at += len(k)
    top = total >= often
    frequent = np.stack([words[top].view(np.int64), total[top]]).tobytes()
    n = len(blocks)
    distinct = [int((total > 0).sum())] + [0] * (n - 1)
    columns = (blocks, table.column("shard").to_pylist(), answers, distinct, [frequent] + [b""] * (n - 1))
    return pa.Table.from_batches([batch(_ANSWERS, columns)])


_PAIR_ROWS = pa.schema(
    [("shard", pa.int64()), ("block", pa.int64())] + [(n, pa.binary()) for n in ("contexts", "runs", "words", "counts")]
)


def _pairs(stream: np.ndarray, lengths: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, word) of a block as context * (n + 1) + word, and each token's pair. Context n: start."""
    context = np.empty(len(stream), np.int64)
    context[1:] = stream[:-1]
    context[np.cumsum(lengths) - lengths] = n_words
    return np.unique(context * (n_words + 1) + stream, return_inverse=True)


def _pair_order(pairs: np.ndarray, hashes: np.ndarray, shards: int, frequent: np.ndarray):
    """Each shard's pairs of a block, sorted by the hashes of context and word."""
    with_start = np.append(hashes, _START)
    rank = np.empty(len(with_start), np.int64)
    rank[np.argsort(with_start)] = np.arange(len(with_start))
    u, w = pairs // (len(hashes) + 1), pairs % (len(hashes) + 1)
    order = np.argsort(rank[u] * len(with_start) + rank[w])
    u, w = with_start[u[order]], with_start[w[order]]
    owner = _owner(u, shards)
    hot = np.isin(u, frequent)
    owner[hot] = _owner(u[hot] * np.uint64(0x9E3779B97F4A7C15) ^ w[hot], shards)
    for shard, at in _split(owner, shards):
        yield shard, order[at], u[at], w[at]


def _trie_answers(table: pa.Table, frequent: dict[int, int], weight: float) -> pa.Table:
    """Build the shard's trie from all blocks' counts and answer each block."""
    blocks = table.column("block").to_pylist()
    asked = [
        (_read(c.as_buffer(), "<u8"), _read(r.as_buffer(), "<i4"), _read_short(w.as_buffer()), _read(n.as_buffer(), "<i4"))
        for c, r, w, n in zip(*(table.column(k) for k in ("contexts", "runs", "words", "counts")))
    ]
    u = np.concatenate([np.repeat(c, r)[n > 0] for c, r, _, n in asked])
    w = np.concatenate([w[n > 0] for _, _, w, n in asked])
    n = np.concatenate([n[n > 0] for *_, n in asked])
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    if len(first):
        n = np.add.reduceat(n.astype(np.int64), first)
        u, w = u[first], w[first]
        contexts, inverse = np.unique(u, return_inverse=True)
        total = np.bincount(inverse, n)
        for k, c in enumerate(contexts.tolist()):
            if c in frequent:  # spread over the shards, so the sum here is a part
                total[k] = frequent[c]
        trie = Trie(u, w, n / (total[inverse] + weight))
        answers = [_pack(trie.query(c, r, words)) for c, r, words, _ in asked]
    else:
        answers = [_pack(np.zeros(len(words), np.uint16)) for _, _, words, _ in asked]
    columns = (blocks, table.column("shard").to_pylist(), answers, [0] * len(blocks), [b""] * len(blocks))
    return pa.Table.from_batches([batch(_ANSWERS, columns)])


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver's heap fills up."""
    gc.collect()
    spark._jvm.System.gc()


def score(
    df: DataFrame, held_out: Column, weight: float = WEIGHT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from all rows where ``held_out`` is not true.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    blocks = cut_lineage(source.mapInArrow(_blocks, _BLOCKS_DDL))
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_docs", "words"))).first()
    n = sums.train_tokens
    word_shards = max(1, -(-sums.words // SHARD_WORDS))
    pair_shards = max(1, -(-sums.tokens // SHARD_PAIRS))
    often = max(1, n // (4 * pair_shards))  # at most 4 words a shard are this frequent

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, h, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                hashes, counts = _read(h.as_buffer(), "<u8"), _read(c.as_buffer(), "<i4")
                for shard, at in _split(_owner(hashes, word_shards), word_shards):
                    yield batch(_WORD_ROWS, ([shard], [block], [_pack(hashes[at])], [_pack(counts[at])]))

    word_rows = blocks.select("block", "hashes", "counts").mapInArrow(send_words, "shard long, block long, hashes binary, counts binary")
    word_answers = cut_lineage(word_rows.groupBy("shard").applyInArrow(lambda t: _word_answers(t, often), _ANSWERS_DDL))
    v = word_answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    frequent: dict[int, int] = {int(_START): sums.train_docs}
    for r in word_answers.where("octet_length(frequent) > 0").select("frequent").collect():
        keys, counts = np.frombuffer(bytes(r.frequent), "<i8").reshape(2, -1)
        frequent.update(zip(keys.view(np.uint64).tolist(), counts.tolist()))
    hot = np.array(sorted(frequent), np.uint64)
    _release(spark)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                stream, lengths, hashes = _read(row["stream"], "<i4"), _read(row["lengths"], "<i4"), _read(row["hashes"], "<u8")
                pairs, inverse = _pairs(stream, lengths, len(hashes))
                train = np.repeat(_read(row["held"], np.uint8) == 0, lengths)
                counts = np.bincount(inverse[train], minlength=len(pairs)).astype("<i4")
                for shard, at, u, w in _pair_order(pairs, hashes, pair_shards, hot):
                    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                    runs = np.diff(np.append(start, len(u))).astype("<i4")
                    yield batch(_PAIR_ROWS, ([shard], [row["block"]], [_pack(u[start])], [_pack(runs)], [_pack(_short(w))], [_pack(counts[at])]))

    ddl = "shard long, block long, contexts binary, runs binary, words binary, counts binary"
    pair_rows = blocks.select("block", "stream", "lengths", "hashes", "held").mapInArrow(send_pairs, ddl)
    pair_answers = cut_lineage(pair_rows.groupBy("shard").applyInArrow(lambda t: _trie_answers(t, frequent, weight), _ANSWERS_DDL))
    del word_rows, pair_rows
    _release(spark)

    out = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_())]
        + [(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [("base_score", pa.float64()), ("score", pa.float64())]
    )

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        main = next(r for r in rows if r["kind"] == 0)
        stream, lengths, hashes = _read(main["stream"], "<i4"), _read(main["lengths"], "<i4"), _read(main["hashes"], "<u8")
        counts = np.zeros(len(hashes) + 1, np.int64)
        answers = {(r["kind"], r["shard"]): r["answer"] for r in rows if r["kind"]}
        for shard, at in _split(_owner(hashes, word_shards), word_shards):
            counts[at] = _read(answers[1, shard], "<i8")
        counts[-1] = sums.train_docs
        pairs, inverse = _pairs(stream, lengths, len(hashes))
        codes = np.zeros(len(pairs), np.uint16)
        for shard, at, _, _ in _pair_order(pairs, hashes, pair_shards, hot):
            codes[at] = _read(answers[2, shard], "<u2")
        u, w = pairs // (len(hashes) + 1), pairs % (len(hashes) + 1)
        plain = (counts[w] + 1.0) / (n + v + 1.0)
        logs = np.log10(dequantise(codes) + weight / (counts[u] + weight) * plain)
        start = np.cumsum(lengths) - lengths
        ids, known = _read(main["ids"], "<i8").tolist(), _read(main["known"], np.uint8)
        columns = (
            [i if k else None for i, k in zip(ids, known)],
            _read(main["held"], np.uint8).astype(bool).tolist(),
            lengths.astype(np.int64),
            np.add.reduceat((counts[stream] > 0).astype(np.int64), start),
            np.full(len(lengths), n, np.int64),
            np.add.reduceat(np.log10(counts[stream] + 1.0), start) - lengths * np.log10(n + v + 1.0),
            np.add.reduceat(logs[inverse], start),
        )
        return pa.Table.from_batches([batch(out, columns)])

    none = F.lit(None).cast("binary")
    parts = ("ids", "known", "held", "lengths", "hashes", "stream")
    main = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("shard"), none.alias("answer"), *parts)
    for kind, answered in ((1, word_answers), (2, pair_answers)):
        main = main.union(answered.select("block", F.lit(kind), "shard", "answer", *(none.alias(p) for p in parts)))
    return main.groupBy("block").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
