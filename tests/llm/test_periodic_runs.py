"""Runs of words against a plain search, with and without the choice of stretches."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from restock.llm import periodic_runs
from restock.llm.periodic_runs import candidate_stretches, detect_runs, dropped, find_runs


def plain_runs(words, least_length=6, least_exponent=4):
    found = {}
    n = len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least_exponent * q) and (i, length) not in found:
                found[i, length] = q  # the smallest period comes first
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words, stretches=None, **limits):
    ids = np.array(words, np.int32)
    return find_runs(ids, np.array([0, len(ids)]), stretches=stretches, **limits)[0]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8),
    st.sampled_from([(6, 4), (1, 3), (9, 3), (20, 5)]),
)
def test_runs_equal_a_plain_search(parts, limits):
    words = [w for block, times in parts for w in block * times]
    limits = {"least_length": limits[0], "least_exponent": limits[1]}
    want = plain_runs(words, **limits)
    assert runs_of(words, **limits) == want
    assert runs_of(words, [(0, len(words))], **limits) == want  # every word appended


def test_no_run_is_lost_between_documents_of_a_chunk():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        block = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        texts.append([rng.randint(0, 60) for _ in range(rng.randint(0, 80))] + block * rng.randint(0, 8) + block[: rng.randint(0, 5)])
    ids = np.array([w for t in texts for w in t], np.int32)
    starts = np.cumsum([0, *map(len, texts)])
    assert find_runs(ids, starts) == [plain_runs(t) for t in texts]
    stretches = candidate_stretches(ids, np.repeat(np.arange(300), np.diff(starts)), 6, 4)
    assert sum(b - a for a, b in stretches) < len(ids)


def test_one_word_for_ever_takes_time_in_proportion():
    import time

    def spent(n, block):
        began = time.process_time()
        assert len(runs_of((list(range(block)) * (n // block + 1))[:n])) == 1
        return time.process_time() - began

    for block in (1, 3, 400):
        spent(1000, 1)
        assert spent(40_000, block) < 12 * max(spent(10_000, block), 0.02)


def test_exponent_below_three_is_refused():
    with pytest.raises(ValueError):
        runs_of([1, 1], least_exponent=2)


def test_dropped_words():
    assert dropped(8, [(1, 6, 2)]).tolist() == [False, False, False, True, True, True, True, False]
    assert dropped(0, []).tolist() == []


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 3)
    texts = [None, "", " \t\n", "a b", "x " * 7, "x\x0by\x0cx y x y x\ty z", "é é " * 4, "x " * 7, "b " + "a " * 9000]
    docs = spark.createDataFrame([(k, t, "r", [1]) for k, t in enumerate(texts)] + [(None, "x " * 6, "r", None)],
                                 "doc_id long, text string, runs string, id array<int>")
    got = {r.doc_id: r for r in detect_runs(docs.repartition(2)).collect()}
    assert len(got) == 10
    for k, text in [*enumerate(texts), (None, "x " * 6)]:
        words = (text or "").encode().split()
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        want = plain_runs([numbers[w] for w in words])
        assert got[k].n_words == len(words)
        assert [tuple(r) for r in got[k].runs] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert got[k].collapsed == " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
    assert got[5].runs == [(0, 8, 2)] and got[5].collapsed == "x y z"
    assert detect_runs(docs.limit(0)).count() == 0
