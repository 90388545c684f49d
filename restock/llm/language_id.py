"""Language ID with interpolated Kneser-Ney character models.

One model per language over the letters of words, with a start and an end mark; the grams of each order
lie in one sorted array of 64-bit hashes, next to a matrix with a column per language. A text gets the
language with the lowest cross-entropy per symbol. It is rejected if that cross-entropy is further above
the language's usual value than almost any text of the calibration fold, with an allowance for
short texts: the limit is ``margin`` times the ``quantile`` of (entropy - mean) / sqrt(a + b / symbols).

Fit: a sample of at most about ``sample_docs`` labelled documents, the same number for each language,
chosen by a hash of the id; two thirds of it count grams, the rest calibrates. This bounds the models,
which are sent to all executors. Texts, whole ones, are only read for their letters: the label, the source
and the id of a text are no input of its prediction.

A null text, or one without a letter, is "und" with score 0, and rejected. Null labels are not learned.
Ties go to the language that sorts first. Without any labelled text everything is "und".
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restock.llm.common import batch, free_name, once_per_process, ragged

ORDER = 4
SAMPLE_DOCS = 8000
SHARPNESS = 12.0
_WORD = re.compile(r"\b[^\W\d_]+\b")  # no part of a key or number
_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = 1, 2  # code points that no word holds
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 200_000
LONGEST_CACHED = 40


def words_of(text: str) -> list[str]:
    """Words of letters; the runs of letters if every one of them touches a digit or underscore."""
    text = text.lower()
    return _WORD.findall(text) or _LETTERS.findall(text)


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(c.isalpha() for c in w) for w in words)


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start mark, letters and end mark of all words, and each symbol's place in its word."""
    marked = "".join([f"\x01{w}\x02" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    _, place = ragged(np.array([len(w) + 2 for w in words], np.int64))
    return codes, place


def _grams(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` symbols that end at ``at``."""
    key = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        key = (key ^ codes[at - k]) * _MULTIPLIER
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Level:
    """Grams of one order: sorted hashes, log probabilities (NaN: not seen) by language."""

    keys: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray  # log weight of the lower order, 0 where the context is not seen


@dataclass
class Models:
    languages: list[str]
    levels: list[Level]
    uniform: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    between: np.ndarray = field(default_factory=lambda: np.zeros(0))
    within: np.ndarray = field(default_factory=lambda: np.zeros(0))
    serial: str = ""

    def plain(self) -> tuple:
        """What is sent to executors: no class of this module, so that a worker need not import it."""
        languages, levels, *others = self.__dict__.values()
        return languages, [tuple(x.__dict__.values()) for x in levels], *others

    @classmethod
    def of(cls, plain: tuple) -> Models:
        return cls(plain[0], [Level(*x) for x in plain[1]], *plain[2:])


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _fit_language(words: list[str], counts: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], float]:
    """For each order: keys, log probabilities, context keys, log backoffs; and log of the floor."""
    codes, place = _symbols(words)
    weight = np.repeat(counts, [len(w) + 2 for w in words])
    predicted = np.flatnonzero(place > 0)
    floor = 1.0 / (len(np.unique(codes[predicted])) + 1)
    tables = []  # per order: keys, counts, context keys, keys of the lower order
    above: tuple[np.ndarray, np.ndarray] | None = None  # distinct grams one longer: an end and its place
    for n in range(ORDER, 0, -1):
        if n == ORDER:
            ends, amount = predicted[place[predicted] >= n - 1], None
            amount = weight[ends]
        else:
            # as counted where the gram starts a word, else one for each distinct longer gram
            start = predicted[place[predicted] == n - 1]
            longer = above[0]
            ends = np.concatenate([start, longer])
            amount = np.concatenate([weight[start], np.ones(len(longer), np.int64)])
        keys, first, inverse = np.unique(_grams(codes, ends, n), return_index=True, return_inverse=True)
        total = np.bincount(inverse, amount, len(keys))
        at = ends[first]
        context = _grams(codes, at - 1, n - 1) if n > 1 else np.zeros(len(at), np.uint64)
        lower = _grams(codes, at, n - 1) if n > 1 else None
        tables.append((keys, total, context, lower))
        above = (at, place[at])
    out = []
    below_keys, below_p = None, None
    for keys, total, context, lower in reversed(tables):
        ones, twos = (total == 1).sum(), (total == 2).sum()
        discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5
        contexts, inverse = np.unique(context, return_inverse=True)
        mass, kinds = np.bincount(inverse, total), np.bincount(inverse)
        gamma = discount * kinds / mass
        base = floor if below_keys is None else below_p[np.searchsorted(below_keys, lower)]
        p = np.maximum(total - discount, 0) / mass[inverse] + gamma[inverse] * base
        out.append((keys, np.log(p), contexts, np.log(gamma)))
        below_keys, below_p = keys, p
    return out, float(np.log(floor))


def fit(rows: dict[str, tuple[list[str], np.ndarray]]) -> Models:
    """Models from each language's distinct words and their counts."""
    languages = sorted(rows)
    fitted = [_fit_language(*rows[name]) for name in languages]
    levels = []
    for n in range(ORDER):
        parts = [f[0][n] for f in fitted]
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        logs = np.full((len(keys), len(parts)), np.nan, np.float32)
        contexts = np.unique(np.concatenate([p[2] for p in parts]))
        backoffs = np.zeros((len(contexts), len(parts)), np.float32)
        for k, p in enumerate(parts):
            logs[np.searchsorted(keys, p[0]), k] = p[1]
            backoffs[np.searchsorted(contexts, p[2]), k] = p[3]
        levels.append(Level(keys, logs, contexts, backoffs))
    return Models(languages, levels, np.array([f[1] for f in fitted], np.float32))


def word_scores(models: Models, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language, summed over its symbols, by (word, language)."""
    out = []
    for lo in range(0, len(words), 20_000):
        part = words[lo : lo + 20_000]
        codes, place = _symbols(part)
        at = np.flatnonzero(place > 0)
        found = np.full((len(at), len(models.languages)), np.nan, np.float32)
        weight = np.zeros_like(found)
        for n in range(ORDER, 0, -1):
            level = models.levels[n - 1]
            rows = np.flatnonzero(np.isnan(found).any(1) & (place[at] >= n - 1))
            if not len(rows):
                continue
            here = at[rows]
            k, known = _lookup(level.keys, _grams(codes, here, n))
            values = np.where(known[:, None], level.logs[k], np.nan)
            todo = np.isnan(found[rows])
            found[rows] = np.where(todo, values + weight[rows], found[rows])
            context = _grams(codes, here - 1, n - 1) if n > 1 else np.zeros(len(here), np.uint64)
            k, known = _lookup(level.contexts, context)
            weight[rows] += np.where(known[:, None], level.backoffs[k], 0)
        found = np.where(np.isnan(found), weight + models.uniform, found)
        sizes = np.array([len(w) + 1 for w in part], np.int64)
        out.append(np.add.reduceat(found.astype(np.float64), np.cumsum(sizes) - sizes, axis=0))
    return np.concatenate(out) if out else np.zeros((0, len(models.languages)))


class Scorer:
    """Word scores with a cache that all tasks of a process share."""

    def __init__(self, models: Models):
        self.models = models
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(models.languages)))

    def texts(self, texts: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray]:
        """Has letters; cross-entropies by (text, language); symbols."""
        split = [words_of(t) for t in texts]
        letters = [has_letter(w) for w in split]
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        fresh = sorted({w for words in split for w in words if w not in self.known})
        for w in fresh:
            self.known[w] = len(self.known)
        if fresh:
            self.scores = np.concatenate([self.scores, word_scores(self.models, fresh)])
        get = self.known.__getitem__
        sums = np.zeros((len(texts), len(self.models.languages)))
        symbols = np.zeros(len(texts), np.int64)
        for k, words in enumerate(split):
            if words:
                numbers, times = np.unique(np.fromiter(map(get, words), np.int64, len(words)), return_counts=True)
                sums[k] = times @ self.scores[numbers]
                symbols[k] = sum(map(len, words)) + len(words)
        if any(len(w) > LONGEST_CACHED for w in fresh):  # long runs of letters are not kept
            self.known, self.scores = {}, self.scores[:0]
        return letters, -sums / np.maximum(symbols, 1)[:, None], symbols


_PREDICTED = pa.schema(
    [("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("symbols", pa.int64()), ("rejected", pa.bool_())]
)
_PREDICTED_DDL = "lang_pred string, score double, entropy double, symbols long, rejected boolean"


def _predict(scorer: Scorer, texts: list[str]) -> list[list]:
    models = scorer.models
    if not models.languages:
        n = len(texts)
        return [["und"] * n, [0.0] * n, [None] * n, [0] * n, [True] * n]
    letters, entropy, symbols = scorer.texts(texts)
    best = entropy.argmin(1)
    low = entropy[np.arange(len(texts)), best]
    score = 1 / np.exp(SHARPNESS * np.minimum(low[:, None] - entropy, 0)).sum(1)
    rejected = np.zeros(len(texts), bool)
    if len(models.limit):
        spread = np.sqrt(models.between[best] + models.within[best] / np.maximum(symbols, 1))
        rejected = low - models.mean[best] > models.limit[best] * spread
    return [
        [models.languages[b] if x else "und" for b, x in zip(best, letters)],
        [float(s) if x else 0.0 for s, x in zip(score, letters)],
        [float(e) if x else None for e, x in zip(low, letters)],
        [int(s) if x else 0 for s, x in zip(symbols, letters)],
        [bool(r) or not x for r, x in zip(rejected, letters)],
    ]


def predict(df: DataFrame, models: Models, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, entropy (nats per symbol), symbols, rejected; a row per row."""
    sent = df.sparkSession.sparkContext.broadcast(models.plain())
    source = df.select(F.col(text_col).alias(free_name(df, "_text")), *keep)
    fields = source.schema.fields[1:]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [_PREDICTED_DDL])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once_per_process("language", models_serial, lambda: Scorer(Models.of(sent.value)))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                columns = _predict(scorer, [t.as_py() or "" for t in part.column(0)])
                arrays = [part.column(k) for k in range(1, part.num_columns)]
                arrays += [pa.array(c, f.type) for c, f in zip(columns, _PREDICTED)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*list(part.schema)[1:], *_PREDICTED]))

    models_serial = models.serial
    return source.mapInArrow(work, ddl)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    counts: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
    for lang, found in counts.items():
        words = list(found)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            yield batch(schema, ([lang] * len(part), part, [found[w] for w in part]))


def learn(
    df: DataFrame, trainable: Column, sample_docs: int = SAMPLE_DOCS, quantile: float = 0.999, margin: float = 3.0,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Models:
    """Fit the models on a bounded sample of the ``trainable`` rows with a label."""
    import uuid

    labelled = df.where(trainable).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Models([], [], np.zeros(0), serial=uuid.uuid4().hex)
    each = max(1, sample_docs // len(sizes))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map([F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    sample = labelled.where(draw < rate[F.col("lang")])
    third = F.pmod(F.xxhash64(F.lit("third"), "id"), F.lit(3)) == 0

    def count(part: DataFrame) -> dict[str, tuple[list[str], np.ndarray]]:
        counted = part.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
        words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
        langs = words.column("lang").to_numpy()
        names, numbers = words.column("word").to_numpy(), words.column("n").to_numpy()
        return {lang: (names[langs == lang].tolist(), numbers[langs == lang]) for lang in set(langs)}

    rows = count(sample.where(~third))
    rare = sorted(set(sizes) - set(rows))
    if rare:  # so few rows that all fell to the other third
        rows |= count(sample.where(F.col("lang").isin(rare)))
    if not rows:
        return Models([], [], np.zeros(0), serial=uuid.uuid4().hex)
    models = fit(dict(sorted(rows.items())))
    models.serial = uuid.uuid4().hex
    held = predict(sample.where(third & ~F.col("lang").isin(rare)), models, keep=("lang",)).where("lang = lang_pred and symbols > 0")
    usual = {
        r.lang: r
        for r in held.groupBy("lang").agg(
            (F.sum(F.col("entropy") * F.col("symbols")) / F.sum("symbols")).alias("mean"), F.count("*").alias("n")
        ).collect()
    }
    k = len(models.languages)
    models.mean = np.array([usual[x].mean if x in usual else 0.0 for x in models.languages])
    models.between = np.full(k, 0.01)
    models.within = np.full(k, 1.0)
    mean = F.create_map([F.lit(x) for pair in zip(models.languages, models.mean.tolist()) for x in pair])
    excess = (F.col("entropy") - mean[F.col("lang")]) / F.sqrt(F.lit(0.01) + F.lit(1.0) / F.col("symbols"))
    top = {r.lang: r.q for r in held.groupBy("lang").agg(F.percentile_approx(excess, F.lit(quantile), F.lit(10_000)).alias("q")).collect()}
    # a language without calibration texts rejects nothing
    models.limit = np.array([max(margin * top[x], 4.0) if x in top else np.inf for x in models.languages])
    models.serial = uuid.uuid4().hex
    return models
