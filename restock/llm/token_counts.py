"""Token counts of sections from one encoding of the whole document.

A document is encoded once, whole. The vocabulary is byte-level, so the bytes of its tokens, laid end
to end, are the text; running sums give every token's span, which is joined with the section spans by
binary search. A section is a line with its line feed. A token that crosses a boundary goes to one
section by ``rule``: "majority" (the section with most of its bytes, ties to the earlier), "start" (the
section of its first byte) or "end" (that of its last byte). ``token_share`` divides such a token by
bytes instead; both add up to the document's tokens.

A null or empty text has one empty section with no tokens. Repeated rows are counted row by row; an
empty table gives no rows; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, once_per_process
from restock.llm.secret_scan import load_encoding

_SECTIONS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")] + [("token_share", pa.float64())]
)
OUT_ROWS = 50_000


class Counter:
    def __init__(self, path: str):
        self.encoding: tiktoken.Encoding = load_encoding(path)
        n = self.encoding.max_token_value + 1
        self.sizes = np.zeros(n, np.int64)
        for token in range(n):
            try:
                self.sizes[token] = len(self.encoding.decode_single_token_bytes(token))
            except KeyError:
                pass  # a number without a token

    def sections(self, text: str, rule: str) -> list[np.ndarray]:
        """start, end (code points), whole tokens, crossing tokens, shares; all by section."""
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        feeds = np.flatnonzero(raw == 10) + 1
        edges = feeds if len(feeds) and feeds[-1] == len(raw) else np.append(feeds, len(raw))
        n = len(edges)
        first, last = np.searchsorted(edges, starts, "right"), np.searchsorted(edges, ends - 1, "right")
        chosen = last.copy() if rule == "end" else first.copy()
        crossing = np.flatnonzero(first != last)
        share = np.bincount(first, minlength=n).astype(np.float64)
        touched = np.zeros(n, np.int64)
        begins = np.append(0, edges[:-1])
        for t in crossing:  # few: a token that holds a line feed and what follows it
            near = np.arange(first[t], last[t] + 1)
            parts = np.minimum(edges[near], ends[t]) - np.maximum(begins[near], starts[t])
            share[first[t]] -= 1
            share[near] += parts / parts.sum()
            touched[near] += 1
            if rule == "majority":
                chosen[t] = near[np.argmax(parts)]
        whole = np.bincount(chosen, minlength=n)
        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        return [points[begins], points[edges], whole, touched, share]


def count_tokens(
    df: DataFrame, vocabulary: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens, token_share."""
    if rule not in ("majority", "start", "end"):
        raise ValueError(f"unknown rule {rule}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_process("token counter", vocabulary, lambda: Counter(vocabulary))
        held: list[list[np.ndarray]] = []
        ids: list[int] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows
            sizes = np.array([len(h[0]) for h in held])
            column = [np.concatenate([h[k] for h in held]) for k in range(5)]
            doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            section = np.concatenate([np.arange(s) for s in sizes])
            total = np.repeat([int(h[2].sum()) for h in held], sizes)
            held.clear()
            ids.clear()
            rows = 0
            return batch(_SECTIONS, (doc, section, column[0], column[1], column[2], column[3], total, column[4]))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(counter.sections(text.as_py() or "", rule))
                ids.append(doc_id)
                rows += len(held[-1][0])
                if rows >= OUT_ROWS:
                    yield flush()
        if held:
            yield flush()

    ddl = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long, token_share double"
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, ddl)
