"""Secret scan: fixed patterns and a token-efficiency test.

Patterns find assigned values, access keys and long lower-case hex runs. The token-efficiency test
looks at every run of 16 or more key characters: prose and code cost about one token for four
characters, random strings cost one token for less than ``max_ratio`` characters under the same
vocabulary. Known digests (hex of a digest's length, UUIDs) and plain numbers are excluded before the
test; a run that a pattern span already covers is not reported again. Identifiers (snake, kebab,
camel or upper case) pass if their words are token-efficient. In a run that passes, stretches of 16
or more characters between words (a key after a path, a name or a prefix) are tested on their own
and reported up to the separators around them.

Spans are kind:start:end in code points, end exclusive, ordered by start and then by kind in the order
assign, access, hex, random. A null text is an empty text and has no spans. Repeated rows are scanned
row by row; an empty table gives no rows. Long texts are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, once_per_process

# fixed values: kinds in order, least lengths, digest lengths in hex digits
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_UUIDS = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# a stretch ends where words undo so much of its score; letters a token of a word
DROP, WORD_RATIO = 4.0, 3.0

_OUT = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_assign", "n_access", "n_hex", "n_random")]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def load_encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    if run.isdigit() or _UUID.fullmatch(run):
        return True
    return len(run) in DIGEST_LENGTHS and bool(_HEX.fullmatch(run) or _HEX.fullmatch(run.lower()) and run.isupper())


def n_tokens(run: str, encoding: tiktoken.Encoding) -> int:
    return len(encoding.encode_ordinary(run))


def word_tokens(word: str, encoding: tiktoken.Encoding) -> int:
    """Tokens of a part of a run; upper-case words are spelled in more tokens than lower-case ones."""
    n = n_tokens(word, encoding)
    return n if word.islower() or word.isdigit() else min(n, n_tokens(word.lower(), encoding))


def is_identifier(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    """Words in snake, kebab or camel case whose letters have ``max_ratio`` characters a token, in either case."""
    words = [p for p in _PART.findall(run) if not p[0].isdigit()]
    letters = sum(map(len, words))
    return 3 * letters >= 2 * len(run) and letters >= max_ratio * sum(word_tokens(w, encoding) for w in words)


def is_random(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    return len(run) < max_ratio * n_tokens(run, encoding) and not is_identifier(run, encoding, max_ratio)


def stretches(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int]]:
    """Stretches of a run whose parts have few characters a token, in one pass over the parts.

    Each part scores ``max_ratio`` times its tokens less its characters, so random parts gain and words
    lose. A stretch is grown over parts that are no words, has to fail the test as a run would, and is
    reported with its whole segments, further short ones and padding.
    """
    known = [m.span() for m in _UUIDS.finditer(run)]
    segments = [m.span() for m in _SEGMENT.finditer(run)]
    known += [s for s in segments if s[1] - s[0] in DIGEST_LENGTHS and is_known(run[slice(*s)])]
    known.sort()
    parts: list[tuple[int, int, float, int]] = []  # start, end, score, segment; known parts score minus infinity
    at = 0
    for number, (low, high) in enumerate(segments):
        while at < len(known) and known[at][1] <= low:
            at += 1
        if at < len(known) and known[at][0] <= low:
            parts.append((low, high, -math.inf, number))
            continue
        for m in _PART.finditer(run, low, high):
            parts.append((*m.span(), max_ratio * word_tokens(m.group(), encoding) - len(m.group()), number))

    def is_word(part: tuple[int, int, float, int]) -> bool:
        start, end, score, _ = part
        size = end - start
        return score == -math.inf or size >= 4 and run[start].isalpha() and size * max_ratio >= WORD_RATIO * (score + size)

    # how far a stretch that begins or ends at a part is widened: over the parts of its segment that are no words
    plain = [not is_word(p) for p in parts]
    begin, finish = list(range(len(parts))), list(range(len(parts)))
    for k in range(1, len(parts)):
        if parts[k - 1][3] == parts[k][3] and plain[k - 1]:
            begin[k] = begin[k - 1]
    for k in range(len(parts) - 2, -1, -1):
        if parts[k + 1][3] == parts[k][3] and plain[k + 1]:
            finish[k] = finish[k + 1]
    found: list[tuple[int, int]] = []
    judged: set[tuple[int, int]] = set()

    def emit(first: int, last: int) -> None:
        first, last = begin[first], finish[last]
        # each widened stretch is encoded once, and none within what is reported already
        if (first, last) in judged or found and parts[last][1] <= found[-1][1]:
            return
        judged.add((first, last))
        text = run[parts[first][0] : parts[last][1]]
        if len(text) < 16 or not any(map(str.isalpha, text)) or not is_random(text, encoding, max_ratio):
            return
        low, high = parts[first][3], parts[last][3]
        short = lambda s: s[1] - s[0] < 4
        while low and short(segments[low - 1]):
            low -= 1
        while high + 1 < len(segments) and short(segments[high + 1]):
            high += 1
        start, end = segments[low][0], segments[high][1]
        while end < len(run) and run[end] == "=":
            end += 1
        if found and start < found[-1][1]:
            before = found.pop()
            start, end = before[0], max(end, before[1])
        found.append((start, end))

    first, last, total, best = -1, -1, 0.0, 0.0
    for k, (_, _, score, _) in enumerate(parts):
        total += score
        if first >= 0 and (total <= 0 or total < best - DROP):
            emit(first, last)
            first, total, best = -1, max(score, 0.0), 0.0
        total = max(total, 0.0)
        if total > best:
            first, last, best = k if first < 0 else first, k, total
    if first >= 0:
        emit(first, last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the pattern matches."""
    found = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end(), m.start(1)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), 1, m.end(), m.start()))
    for m in _LONG_HEX.finditer(text):  # a maximal run of 16 or more
        found.append((m.start(), 2, m.end(), m.start()))
    return sorted(found)


def find_secrets(text: str, encoding: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int, int, int]]:
    base = base_spans(text)
    found = list(base)
    at, reach = 0, 0

    def covered(start: int, end: int) -> bool:
        nonlocal at, reach
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        return reach >= end

    for m in _RUN.finditer(text):
        run = m.group()
        if covered(m.start(), m.end()) or is_known(run):
            continue
        if is_random(run, encoding, max_ratio):
            found.append((m.start(), 3, m.end(), m.start()))
            continue
        for low, high in stretches(run, encoding, max_ratio):
            start, end = m.start() + low, m.start() + high
            if not covered(start, end):
                found.append((start, 3, end, start))
    return sorted(found)


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(df: DataFrame, vocabulary: str, max_ratio: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts by kind, a digest of the pattern spans, and all spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = once_per_process("scan", vocabulary, lambda: load_encoding(vocabulary))
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                spans = find_secrets(text.as_py() or "", encoding, max_ratio)
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                base = joined([s for s in spans if s[1] < 3])
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            yield batch(_OUT, zip(*rows)) if rows else batch(_OUT, [[]] * len(_OUT))

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, ddl)


def redact(df: DataFrame, vocabulary: str, mark: str = "[SECRET]", max_ratio: float = 2.2, text_col: str = "text") -> DataFrame:
    """``df`` with every secret value replaced by ``mark``; all rows and other columns stay. Null stays null."""

    def clean(text: str | None, encoding: tiktoken.Encoding) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, end in sorted((value, end) for _, _, end, value in find_secrets(text, encoding, max_ratio)):
            if end > at:
                out += [text[at:start], mark] if start >= at else []
                at = end
        return "".join(out) + text[at:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = once_per_process("scan", vocabulary, lambda: load_encoding(vocabulary))
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = pa.array([clean(t.as_py(), encoding) for t in b.column(k)], b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), texts)

    return df.mapInArrow(work, df.schema)
