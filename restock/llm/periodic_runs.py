"""Periodic runs of words: stretches that repeat themselves several times in a row.

A run is a stretch of words with smallest period q (words q apart are identical) and length of at least
``least_length`` and ``least_exponent`` * q that no neighbouring word extends. Per document, words are appended
one by one to a suffix automaton whose suffix links are kept as a link-cut forest. The preferred paths of
the forest join states with the same last occurrence: the access after an append recolours the path from the
new state to the root, and every path segment that it meets tells how far back (distance d) the longest suffix
of that segment (length l) ended before. d <= l is a square. With l >= (least_exponent - 1) * d the distance is
the smallest period of the repetition, which is then extended in both directions to the run. An access costs
O(log n) amortised, on a text of one repeated word too.

Not every word has to be appended: each word of a run but those of its last period occurs again within a period.
Stretches that are long enough for a period class (powers of two) are found by comparing next occurrences, and
the automaton reads only those. No run is lost, which the tests show.

Each document is a row of its own: nothing is shuffled or grouped. Memory is bounded by one document; a
candidate stretch takes up to about 700 bytes a word. A null or empty text has no words and no runs; repeated
rows are treated row by row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import utf8_texts

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
CHUNK_WORDS = 200_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.large_string())])
_DDL = "n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


def repetitions(words: list[int], least_length: int, least_exponent: int) -> Iterator[tuple[int, int, int]]:
    """(end, distance, length): the longest suffix before word ``end`` (inclusive) that ended ``distance`` words
    earlier too, wherever that repeats long enough. Suffix automaton with link-cut access."""
    times = least_exponent - 1
    size, link, step = [0], [-1], [{}]  # automaton: longest suffix of a state, suffix link, transitions
    up, left, right = [-1], [-1], [-1]  # splay trees by depth; ``up`` of a tree's root is the path above it
    seen = [-1]  # last occurrence of a preferred path, held at the root of its tree

    def state(length: int, suffix: int, moves: dict) -> int:
        size.append(length)
        link.append(suffix)
        step.append(moves)
        up.append(-1)
        left.append(-1)
        right.append(-1)
        seen.append(-1)
        return len(size) - 1

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if p < 0 or left[p] != x and right[p] != x:
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        else:
            seen[x] = seen[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p] = x
        up[x] = g

    last = 0
    for end, word in enumerate(words):
        new = state(end + 1, 0, {})
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[p] + 1 != size[q]:
                # a state between q and its suffix link, with q's occurrences so far: it joins q's path above q
                copy = state(size[p] + 1, link[q], step[q].copy())
                splay(q)
                above = left[copy] = left[q]
                if above >= 0:
                    up[above] = copy
                left[q] = copy
                up[copy] = q
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        up[new] = link[new]
        last = below = new
        x = up[new]
        while x >= 0:
            splay(x)
            distance = end - seen[x]
            length = size[x]
            if length >= times * distance and length + distance >= least_length:
                yield end, distance, length
            deeper = right[x]
            if deeper >= 0:
                seen[deeper] = seen[x]
            right[x] = below
            below = x
            x = up[x]
        seen[below] = end


def candidate_stretches(
    ids: np.ndarray, document: np.ndarray, least_length: int, least_exponent: int
) -> list[tuple[int, int]]:
    """Stretches (start, end) of word numbers outside which no run can lie, disjoint and in order.

    In a run of period q, all words but the last q occur again within q words. For q from Q/2 + 1 to Q those
    are at least (least_exponent - 1) * q consecutive words whose next occurrence is at most Q words away.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ahead = np.full(n, n + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    same &= document[order[1:]] == document[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    covers = np.zeros(n + 1, np.int64)
    longest = int(np.bincount(document).max()) if n else 0
    reach, shortest = 1, 1
    while shortest * least_exponent <= longest:
        need = max(least_length - reach, (least_exponent - 1) * shortest)
        near = np.flatnonzero(np.diff(ahead <= reach, prepend=False, append=False))
        start, end = near[::2], near[1::2]
        long = end - start >= need
        np.add.at(covers, start[long], 1)
        np.add.at(covers, np.minimum(end[long] + reach, n), -1)
        reach, shortest = 2 * reach, reach + 1
    edges = np.flatnonzero(np.diff(np.cumsum(covers)[:n] > 0, prepend=False, append=False))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def find_runs(
    ids: np.ndarray, starts: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
    stretches: list[tuple[int, int]] | None = None,
) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period of each document; ``starts`` bound the documents' ids."""
    if least_exponent < 3:
        raise ValueError("runs of fewer than three periods have more than one period")
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if stretches is None:
        stretches = candidate_stretches(ids, document, least_length, least_exponent)
    for low, high in stretches:
        # a stretch's margin may reach into the next document
        while low < high:
            number = int(document[low])
            first, stop = int(starts[number]), int(starts[number + 1])
            top = min(high, stop)
            words = ids[low:top].tolist()
            whole: list[int] | None = None
            open_runs: dict[int, int] = {}  # period: the word after its last run
            for end, period, length in repetitions(words, least_length, least_exponent):
                if low + end < open_runs.get(period, -1):
                    continue
                if whole is None:
                    whole = ids[first:stop].tolist()
                begin = low - first + end - period - length + 1
                after = low - first + end + 1
                while begin and whole[begin - 1] == whole[begin - 1 + period]:
                    begin -= 1
                while after < len(whole) and whole[after] == whole[after - period]:
                    after += 1
                open_runs[period] = first + after
                found[number].append((begin, after - begin, period))
            low = top
    # two stretches of one document may both show a run that spans them
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in found]


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a run holds the word after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def _documents(texts: list[bytes], least_length: int, least_exponent: int) -> pa.RecordBatch:
    split = [t.split() for t in texts]  # bytes.split() cuts at space and 0x09 to 0x0D only
    known = {w: k for k, w in enumerate(set().union(*split))}
    starts = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int32, int(starts[-1]))
    collapsed = []
    every = find_runs(ids, starts, least_length, least_exponent)
    for words, runs in zip(split, every):
        if runs:
            gone = dropped(len(words), runs)
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        collapsed.append(b" ".join(words))
    flat = np.array([r for runs in every for r in runs], np.int64).reshape(-1, 3)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in every])]).astype(np.int32)
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN)))
    columns = [pa.array(np.diff(starts)), runs, pa.array(collapsed, pa.large_binary()).cast(pa.large_string())]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def detect_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """Per row: the id, n_words, ``runs`` by start and period, and the text with each run cut to one period.

    ``collapsed`` has one space between words.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, low, held = [], 0, 0
            for k, text in enumerate(utf8_texts(b.column(1))):
                texts.append(text)
                held += len(text)
                if held >= 6 * CHUNK_WORDS or k + 1 == b.num_rows:
                    out = _documents(texts, least_length, least_exponent)
                    columns = [b.column(0).slice(low, len(texts)), *out.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", *_OUT.names])
                    texts, low, held = [], k + 1, 0

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, {_DDL}").withColumnRenamed("id", id_col)
