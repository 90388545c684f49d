"""Language ID, n-gram scores and near-duplicates against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from restock.llm import dart_minhash, language_id, ngram_score
from restock.llm.common import fold
from restock.llm.decontaminate import split_words

FOLDER = "/root/testdata/sf0.001"
EN = "the that with and from other think whether thing other over under water weather".split()
DE = "der die das und nicht schön über straße wasser wetter zwischen auch eine keiner".split()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(EN if k % 2 else DE, k=30)), "en" if k % 2 else "de", "s") for k in range(200)]
    rows += [(500, None, "en", "s"), (501, "", "de", "s"), (502, "123 ---", "en", "s"), (503, "das wasser", None, "s"), (504, "a1 b2", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string")


def test_language_models_sum_to_one():
    words = ["aba", "abb", "b", "bab"]
    models = language_id.fit({"x": (words, np.array([3, 1, 2, 1]))})
    for start in ("", "a", "ab", "ba", "zz"):
        total = 0.0
        for symbol in "ab\x02":
            # a word that goes on with the symbol: the score of its last predicted symbol
            text = f"\x01{start}{symbol}"
            codes = np.array([ord(c) for c in text], np.uint64)
            at = np.array([len(text) - 1])
            p, weight = None, 0.0
            for n in range(language_id.ORDER, 0, -1):
                if len(text) < n:
                    continue
                level = models.levels[n - 1]
                k, known = language_id._lookup(level.keys, language_id._grams(codes, at, n))
                if known[0]:
                    p = level.logs[k[0], 0] + weight
                    break
                context = language_id._grams(codes, at - 1, n - 1) if n > 1 else np.zeros(1, np.uint64)
                k, known = language_id._lookup(level.contexts, context)
                weight += level.backoffs[k[0], 0] if known[0] else 0
            total += math.exp(p if p is not None else weight + models.uniform[0])
        total += math.exp(weight_of_unseen(models, start))
        assert abs(total - 1) < 1e-5


def weight_of_unseen(models, start):
    codes = np.array([ord(c) for c in f"\x01{start}?"], np.uint64)
    at, weight = np.array([len(codes) - 1]), 0.0
    for n in range(language_id.ORDER, 0, -1):
        if len(codes) < n:
            continue
        level = models.levels[n - 1]
        context = language_id._grams(codes, at - 1, n - 1) if n > 1 else np.zeros(1, np.uint64)
        k, known = language_id._lookup(level.contexts, context)
        weight += level.backoffs[k[0], 0] if known[0] else 0
    return weight + models.uniform[0]


def test_language_prediction(labelled):
    models = language_id.learn(labelled, fold(F.col("doc_id"), 5) != 0)
    rows = {r.doc_id: r for r in language_id.predict(labelled, models).collect()}
    assert len(rows) == 205
    assert all(rows[k].lang_pred == ("en" if k % 2 else "de") and not rows[k].rejected for k in range(200))
    assert [rows[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3
    assert all(rows[k].rejected and rows[k].score == 0 for k in (500, 501, 502))
    assert rows[503].lang_pred == "de" and rows[504].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in rows.values())
    junk = labelled.sparkSession.createDataFrame([(1, "xkqz vvjq wqxz " * 40), (2, "漢字仮名" * 50)], "doc_id long, text string")
    assert all(r.rejected for r in language_id.predict(junk, models).collect())


def test_language_without_labels(labelled):
    models = language_id.learn(labelled.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    rows = language_id.predict(labelled, models).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert language_id.predict(labelled.limit(0), models).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    models = language_id.learn(docs, fold(F.col("doc_id"), 5) != 0)
    held = docs.where(fold(F.col("doc_id"), 5) == 0)
    rows = language_id.predict(held, models, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_elias_fano_finds_every_value():
    rng = np.random.default_rng(0)
    for top, n in ((2**64 - 1, 700), (2**63, 5), (900, 800), (50, 50), (10**12, 9000)):
        values = np.unique(rng.integers(0, top + 1, n, dtype=np.uint64))
        coded = ngram_score.EliasFano(ngram_score.EliasFano.encode(values))
        assert (coded.at(np.arange(len(values))) == values).all()
        assert (coded.find(values) == np.arange(len(values))).all()
        asked = rng.integers(0, top + 1, 3000, dtype=np.uint64)
        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        assert (coded.find(asked) == np.where(values[at] == asked, at, -1)).all()
    assert (ngram_score.EliasFano(ngram_score.EliasFano.encode(np.zeros(0, np.uint64))).find(np.array([3], np.uint64)) == -1).all()


@pytest.mark.parametrize("block, pairs, words", [(10_000_000, 10_000_000, 10_000_000), (60, 40, 10)])
def test_scores_equal_brute_force(spark, monkeypatch, block, pairs, words):
    monkeypatch.setattr(ngram_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_score, "SHARD_PAIRS", pairs)
    monkeypatch.setattr(ngram_score, "SHARD_WORDS", words)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(EN + ["The", "é x", "q" * 300], k=rng.randint(0, 25))) for _ in range(60)] + [None, "", " \t\n", "THE the"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 1), (None, "the", 1)], "doc_id long, text string, held int")
    got = ngram_score.score(docs.repartition(3), fold(F.col("doc_id"), 7) == 2).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[w for w in _split((t or "").translate(low)) if w] + ["\0"] for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    one, two = Counter(), Counter()
    for t, o in zip(tokens, out):
        if not o:
            one.update(t)
            two.update(zip(["^"] + t, t))
    n, v = sum(one.values()), len(one)
    one_at = one | Counter({"^": out.count(False)})
    want = []
    for (i, _), t, o in zip(rows, tokens, out):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        k = ngram_score.WEIGHT
        p = sum(math.log10((two[u, w] + k * (one[w] + 1) / (n + v + 1)) / (one_at[u] + k)) for u, w in zip(["^"] + t, t))
        want.append((repr(i), o, len(t), sum(one[w] > 0 for w in t), n, base, p))
    have = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-9)
        assert a[6] == pytest.approx(b[6], abs=2e-4 * a[2])
    assert ngram_score.score(docs.limit(0), F.lit(False)).count() == 0


def _split(text):
    for mark in "\t\n\x0b\x0c\r":
        text = text.replace(mark, " ")
    return text.split(" ")


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**63, 80, dtype=np.uint64))
    wa, wb = rng.random(80) * 3 + 0.05, rng.random(80) * 3 + 0.05
    s = dart_minhash.dart_signatures([(a, wa), (a, wb), (a[:1], np.array([1]))], 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.04)
    whole = dart_minhash.dart_signatures([(a, wa)], 3000)
    assert (whole[0] == s[0]).all()  # independent of the other documents


def brute_classes(rows):
    hashes = dart_minhash.Hashes()
    sets = [dart_minhash.shingles(split_words((t or "").encode()), hashes) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            a, b = sets[i], sets[j]
            same = len(a[0]) and len(b[0]) and dart_minhash.similarity(*a, *b) >= 0.8
            if same or rows[i][1] == rows[j][1]:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for base in [text(n) for n in (60, 80, 120, 200, 40, 7, 300)]:
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    passage = text(60)
    rows += [" ".join(passage + text(rng.randint(20, 60))) for _ in range(25)]  # share much, but not 0.8
    rows += [" ".join(text(9)) for _ in range(10)] + ["a b", "A  b!", "b a", "", "", "...", "...", None, None, "line one of it " * 200, "line one of it " * 230]
    numbered = [(k, t) for k, t in enumerate(rows)]
    return numbered, spark.createDataFrame([(*r, "x") for r in numbered], "doc_id long, text string, node string").coalesce(1)


def test_classes_equal_brute_force(copies):
    rows, df = copies
    want = brute_classes(rows)
    got = {r.doc_id: r for r in dart_minhash.classes(df).collect()}
    assert [got[k].class_id for k, _ in rows] == want
    sizes = Counter(want)
    assert all(got[k].class_size == sizes[want[k]] and got[k].kept == (want[k] == k) for k, _ in rows)


def test_deduplicate_keeps_one_of_each_class(copies):
    rows, df = copies
    renamed = df.withColumn("_row", F.lit(1)).withColumn("label", F.lit(2))
    kept = dart_minhash.deduplicate(renamed)
    assert kept.columns == renamed.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(brute_classes(rows)))
    assert dart_minhash.deduplicate(df.limit(0)).count() == 0


def test_prefix_join_finds_all_similar_pairs(spark, copies):
    rows, _ = copies
    hashes = dart_minhash.Hashes()
    sets = {k: dart_minhash.shingles(split_words((t or "").encode()), hashes) for k, t in rows}
    sets = {k: s for k, s in sets.items() if len(s[0])}
    name = lambda k: k.to_bytes(4, "big")
    table = spark.createDataFrame(
        [(bytearray(name(k)), bytearray(h.tobytes()), bytearray(w.astype("<i4").tobytes())) for k, (h, w) in sets.items()],
        "node binary, hashes binary, weights binary",
    )
    labels = table.select("node", F.col("node").alias("label"))
    found = {(bytes(r.a), bytes(r.b)) for r in dart_minhash.prefix_pairs(table, labels, 0.8).collect()}
    want = {(name(i), name(j)) for i in sets for j in sets if i < j and dart_minhash.similarity(*sets[i], *sets[j]) >= 0.8}
    assert want <= found
