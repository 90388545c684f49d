"""Token ids of whole texts with a ``tokenizers`` vocabulary of lower-case words.

For a vocabulary that lower-cases, drops white space and ends words within a token, the ids of a
text are the ids of its white-space-free chunks one after another. So each distinct chunk goes
through the library once per process, and a text becomes a run of look-ups. Chunks of ASCII characters
and of letters are cut further where the vocabulary's own pattern cuts; every other chunk, and every
text that spells a special token, goes through the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np

from restock.llm.common import once_per_process

CACHE_CHUNKS = 500_000
CACHE_IDS = 8 * CACHE_CHUNKS  # of all cached chunks together, as chunks may be long
STEP_TEXTS = 500  # callers pass so many texts at once: their chunks are held beside the cache
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: as the vocabulary's pattern for ASCII; runs of bytes from 0x80 are taken as letters and checked
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+")
_PLAIN = re.compile(rb"[\x21-\x7e]+")
_STOPS = frozenset((b".", b",", b";", b":", b"!", b"?"))


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: 0x100 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``array`` with ``values`` from ``at`` on; it grows by a quarter or more if they do not fit."""
    end = at + len(values)
    if end > len(array):
        array = np.concatenate([array[:at], np.zeros(end + end // 4 - at, array.dtype)])
    array[at:end] = values
    return array


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # the number of a chunk or piece
        # these have room behind the values of the known ones, so that new chunks do not move all
        self.ids = np.zeros(0, np.int32)  # ids of all of them, end to end
        self.n_ids = 0
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _thin_out(self) -> None:
        """Keep what was looked up more than once, or of that what was looked up most if it is too much."""
        kept = np.flatnonzero(self.uses[: len(self.known)] > 1)
        if len(kept) > CACHE_CHUNKS // 2 or self.sizes[kept].sum() > CACHE_IDS // 2:
            kept = kept[np.argsort(-self.uses[kept], kind="stable")[: CACHE_CHUNKS // 2]]
            kept = kept[np.cumsum(self.sizes[kept]) <= CACHE_IDS // 2]
            kept.sort()
        names = list(self.known)  # in the order of their numbers
        names = [names[k] for k in kept.tolist()]
        ids, sizes = self._gather(kept), self.sizes[kept]
        self._forget()
        self._add(names, ids, sizes)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, without special tokens, as 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        split: list[list[bytes]] = []
        where = []
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                ids = self.library.encode(text.decode(), add_special_tokens=False).ids
                out[k] = np.array(ids, np.int32)
            else:
                split.append(text.translate(_LOWER).split())
                where.append(k)
        if len(self.known) > CACHE_CHUNKS or self.n_ids > CACHE_IDS:
            self._thin_out()
        chunks = list(chain.from_iterable(split))
        numbers = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            fresh = [chunks[k] for k in missing.tolist()]
            self._learn(set(fresh))
            numbers[missing] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        np.add.at(self.uses, numbers, 1)
        ids = self._gather(numbers)
        ends = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        bounds = ends[np.cumsum([0, *map(len, split)])]
        for k, lo, hi in zip(where, bounds, bounds[1:]):
            out[k] = ids[lo:hi]
        return out

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        return self.ids[np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def _add(self, names: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(names, range(first, first + len(names))))
        self.starts = _put(self.starts, first, self.n_ids + np.cumsum(sizes) - sizes)
        self.sizes = _put(self.sizes, first, sizes)
        self.uses = _put(self.uses, first, np.zeros(len(names), np.int64))
        self.ids = _put(self.ids, self.n_ids, ids)
        self.n_ids += len(ids)

    def _learn(self, chunks: set[bytes]) -> None:
        """Put the ids of new chunks into the cache."""
        if not chunks:
            return
        fresh: dict[bytes, str | None] = {}  # pieces, with their letters if those are not all ASCII
        joined: list[bytes] = []
        parts: list[list[bytes]] = []
        whole: list[bytes] = []
        for c in chunks:
            if c.isalpha():  # ASCII letters only
                fresh[c] = None
                continue
            stem, stop = c[:-1], c[-1:]
            if stop not in _STOPS:
                stem, stop = c, b""
            elif stem.isalpha():  # most others: a word and a stop
                joined.append(c)
                parts.append([stem, stop])
                fresh[stem] = fresh[stop] = None
                continue
            if not c.isascii() and (text := stem.decode()).isalpha():
                if not text.lower().isalpha():  # a letter that becomes a letter and a mark
                    whole.append(c)
                    continue
                fresh[stem] = text
                if stop:
                    fresh[stop] = None
                    joined.append(c)
                    parts.append([stem, stop])
                continue
            found = _PIECES.findall(c)
            letters = [(p, p.decode()) for p in found if not p.isascii()]
            if not all(text.lower().isalpha() for _, text in letters):
                whole.append(c)
                continue
            for p in found:
                fresh[p] = None
            fresh.update(letters)
            if len(found) > 1:
                joined.append(c)
                parts.append(found)
        names = list(fresh.keys() - self.known.keys())
        ids: list[list[int]] = []
        odd = []
        tokenize = self.library.model.tokenize
        for p in names:
            text = fresh[p]
            if text is None:
                if p.isalnum() or _PLAIN.fullmatch(p):
                    ids.append([t.id for t in tokenize(p.decode())])
                    continue
            elif text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                # the vocabulary's model takes each byte as a letter
                ids.append([t.id for t in tokenize(p.decode("latin-1").translate(_BYTE_LETTERS))])
                continue
            odd.append(p)
            ids.append([])
        found = self._library(odd + whole)
        at = {p: x for p, x in zip(odd, found)}
        ids = [at.get(p, x) if not x else x for p, x in zip(names, ids)]
        names += whole
        ids += found[len(odd) :]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(names, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)
        if joined:
            numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            self._add(joined, self._gather(numbers), np.add.reduceat(self.sizes[numbers], np.cumsum(lengths) - lengths))

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


def word_ids(path: str) -> WordIds:
    return once_per_process("word ids", path, lambda: WordIds(path))
