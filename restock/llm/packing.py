"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Each task packs its own documents in groups of about ``GROUP_WINDOWS`` windows; nothing is shuffled and
memory is bounded by a group and one document. Within a group:

1. a document of a window or more gives whole windows; its rest is cut into items,
2. what does not fill whole windows is cut off the largest items into sequences whose length is a
   power of two, which need no padding,
3. the other items are split into equal windows by differencing: the two partial partitions with the
   largest spread are merged so that the heavy windows of one meet the light windows of the other,
4. if a window exceeds the capacity, the number of windows rises by one and step 3 is repeated; the
   added one is cut off like those of step 2 and doubles in size each time.

Every id lies in exactly one piece. A null or empty text has the end id only. Repeated rows are packed
row by row; an empty table gives no rows. Sequence ids are unique over the table, not dense.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, utf8_texts
from restock.llm.word_ids import STEP_TEXTS, word_ids

CAPACITY = 4096
GROUP_WINDOWS = 128
SPARE = 8  # ids left free in a window, so that differencing meets the capacity
LEAST_CUT = 64
LARGEST_ITEM = 512  # small items level out; a rest is cut into items of at most so many ids

_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def multiway_differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into ``k`` sets of nearly equal sums; returns the item numbers of each set."""
    n = len(sizes)
    if not n:
        return [[] for _ in range(k)]
    left: list[int] = []  # children of joined sets, numbered from n
    right: list[int] = []
    # a partial partition: (-spread, number, sums from large to small, sets); empty sets are left out
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, sums2, sets2 = heapq.heappop(heap)
        shared = max(0, len(sums) + len(sums2) - k)
        if shared:
            light, light_sets = sums2[::-1][:shared], sets2[::-1][:shared]
            at = len(sums) - shared
            joined = np.arange(n + len(left), n + len(left) + shared)
            left += sets[at:].tolist()
            right += light_sets.tolist()
            sums = np.concatenate([sums[:at], sums[at:] + light, sums2[: len(sums2) - shared]])
            sets = np.concatenate([sets[:at], joined, sets2[: len(sets2) - shared]])
        else:
            sums, sets = np.concatenate([sums, sums2]), np.concatenate([sets, sets2])
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, serial, sums, sets))
        serial += 1
    out = []
    for top in heap[0][3].tolist():
        items, todo = [], [top]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [left[x - n], right[x - n]]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id of the documents once."""
    sequences: list[list[tuple[int, int, int]]] = []
    items = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        sequences += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        items += [(min(LARGEST_ITEM, n - s), d, s) for s in range(whole, n, LARGEST_ITEM)]
    total = sum(i[0] for i in items)
    windows = total // capacity
    cut = total if not windows else -(-(total - windows * capacity + windows * SPARE) // LEAST_CUT) * LEAST_CUT
    items.sort()

    def cut_off(need: int) -> list[tuple[int, int, int]]:
        """A sequence of ``need`` ids off the ends of the largest items."""
        sequence = []
        while need:
            size, d, start = items.pop()
            take = min(size, need)
            sequence.append((d, start + size - take, take))
            if size > take:
                insort(items, (size - take, d, start))
            need -= take
        return sequence

    while cut:
        need = min(capacity, 1 << (cut.bit_length() - 1))
        sequences.append(cut_off(need))
        cut -= need
    more = LEAST_CUT
    while items:
        sets = multiway_differencing([i[0] for i in items], windows)
        if max(sum(items[i][0] for i in s) for s in sets) <= capacity:
            sequences += [[(items[i][1], items[i][2], items[i][0]) for i in s] for s in sets if s]
            break
        sequences.append(cut_off(min(more, capacity, 1 << (sum(i[0] for i in items).bit_length() - 1))))
        more *= 2
    return sequences


def pack_documents(
    df: DataFrame, encode: Callable[[list[bytes]], list[np.ndarray]] | None = None, tokenizer: str = "",
    end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encode or word_ids(tokenizer).encode
        serial = TaskContext.get().partitionId() << 36
        doc_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, size
            rows = []
            for sequence in pack([len(x) for x in held], capacity):
                offset = 0
                for d, start, length in sequence:
                    crc = zlib.crc32(held[d][start : start + length].tobytes())
                    rows.append((doc_ids[d], start, length, crc, len(held[d]), serial, offset))
                    offset += length
                serial += 1
            doc_ids.clear()
            held.clear()
            size = 0
            return batch(_PIECES, zip(*rows))

        for b in batches:
            texts = list(utf8_texts(b.column(1)))
            for lo in range(0, len(texts), STEP_TEXTS):
                for doc_id, ids in zip(b.column(0)[lo : lo + STEP_TEXTS].to_pylist(), to_ids(texts[lo : lo + STEP_TEXTS])):
                    doc_ids.append(doc_id)
                    held.append(np.append(ids, end_id).astype("<u4"))
                    size += len(held[-1])
                    if size >= GROUP_WINDOWS * capacity:
                        yield flush()
        if held:
            yield flush()

    ddl = ", ".join(f"{f.name} long" for f in _PIECES)
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, ddl)
