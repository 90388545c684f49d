"""Source divergence and curriculum mixtures against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from restock.llm import curriculum, source_divergence
from restock.llm.curriculum import SCHEDULES, assign_positions, integral, training_order
from restock.llm.source_divergence import TermCounter, divergences, radix_order

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_divergences(rows, least_docs=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lowered(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, held in docs.items():
        kept = [t for t, d in held.items() if d >= least_docs]
        sources = sorted((s for l, s in counts if l == lang), key=str.encode)

        def shares(n_of):
            total = sum(n_of(t) for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n_of(t) + 1) // total for t in kept}

        p = {s: shares(counts[lang, s].__getitem__) for s in sources}
        q = shares(lambda t: sum(counts[lang, s][t] for s in sources))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def random_rows(rng, n, sources):
    words = ["a", "b", "Über", "ÜBER", "eightchr", "nine-char", "sixteencharacter", "seventeencharacte", "x" * 40, "naïve", "日本", "word9word"]
    words += [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" * (1 + k % 5) for k in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de"]), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", None, None), ("12 34", "xx", "only"), ("lonely", "yy", "a"), ("lonely", "yy", "b")] + rows[:3]


@pytest.mark.parametrize("tile, shard_rows, held", [(64, 200_000, 1_500_000), (2, 20, 10)])
def test_divergences_equal_a_plain_version(spark, monkeypatch, tile, shard_rows, held):
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", held)
    monkeypatch.setattr(source_divergence, "CHUNK_BYTES", 500)
    rows = random_rows(random.Random(3), 150, ["s1", "s2", "S3", "é", None, ""])
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    got = divergences(docs.repartition(3), top=9)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergences(rows, top=9)


def test_divergences_of_nothing(spark):
    assert divergences(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 500).astype(np.uint64) // 2**62]
    groups = rng.integers(0, 2, 500) * 70_000
    want = sorted(range(500), key=lambda i: (groups[i], words[0][i], words[1][i], i))
    assert radix_order(words, groups).tolist() == want


def test_counter_takes_every_length():
    counter = TermCounter()
    terms = [b"z" * k for k in range(1, 40)]
    counter.add([b" ".join(terms), b"", b"zz zz"], np.array([0, 0, 1]))
    got = {}
    for groups, names, counts, docs in counter.take():
        for row in zip(groups.tolist(), names.to_pylist(), counts.tolist(), docs.tolist()):
            got[row[:2]] = row[2:]
    assert got == {(0, "z" * k): (1, 1) for k in range(1, 40)} | {(1, "zz"): (2, 1)}


def test_shares_are_exact_beyond_the_range_of_products(spark):
    pairs = [(0, 1), (7, 9), (10**15, 10**15 + 3), (5 * 10**14, 2 * 10**15), (9 * 10**12, 9 * 10**12 + 1)]
    df = spark.createDataFrame(pairs, "c long, m long").selectExpr("c", "m", source_divergence.share("c", "m") + " p")
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.m for r in df.collect())


# --- curriculum --------------------------------------------------------------------------------


def plain_targets(sizes, weights, volume=Fraction(3, 2), most=2):
    """Cap, share the excess again, until none is above."""
    target = {}
    left, open_ = volume * sum(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / weight > most * sizes[k]}
        if not over:
            return target | {k: left * weights[k] / weight for k in open_}
        target |= {k: Fraction(most * sizes[k]) for k in over}
        left -= sum(most * sizes[k] for k in over)
        open_ -= over
    return target


def mixture_rows(rng):
    rows = [(k, "w " * int(rng.paretovariate(0.7)), rng.choice(["s0"] * 6 + ["s1", "s2", "Z", "é", None])) for k in range(400)]
    return rows + rows[:5] + [(900, None, "nothing"), (901, "", "nothing"), (None, "a b\x0bc\td", "tiny"), (None, "a b", "tiny")]


def test_mixture(spark):
    rows = mixture_rows(random.Random(8))
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    assigned = assign_positions(docs.repartition(3)).cache()
    got = assigned.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    names = sorted({s for _, _, s in rows if s}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    want = plain_targets(sizes, [[3, 1, 2][k % 3] for k in range(len(names))])
    for k, name in enumerate(names):
        mine = [r for r in got if r.source == name]
        assert {r.source_size for r in mine} == {sizes[k]}
        assert all(math.isclose(r.target, want[k], abs_tol=1e-9) for r in mine)
        assert sum(r.taken for r in mine) == math.floor(mine[0].target)
        assert all(r.taken <= 2 * r.size and r.taken == sum(o.words for o in r.occurrences) for r in mine)
    again = assign_positions(docs.repartition(5)).collect()
    key = lambda r: repr((r.doc_id, r.size, r.taken, r.occurrences))
    assert sorted(map(key, again)) == sorted(map(key, got))

    order = training_order(assigned).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    # at each time a source has given the share of its target that its schedule's integral tells
    for k, name in enumerate(names):
        mine = [r for r in order if r.source == name]
        total, longest = sum(r.words for r in mine), max((r.words for r in mine), default=0)
        (_, w0), (_, w1) = SCHEDULES[k % 3]
        for at in (0.1, 0.5, 0.9):
            demand = total * (w0 * at + (w1 - w0) / 2 * at * at) / integral(SCHEDULES[k % 3])
            assert abs(sum(r.words for r in mine if r.position <= at) - demand) <= longest + 1
    assigned.unpersist()
    assert assign_positions(docs.limit(0)).count() == 0


def test_schedules_with_several_points(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 4.0))
    df = spark.range(0, 101).selectExpr(f"id / 100D * {integral(schedule)} filled")
    for r in df.select("filled", curriculum.inverse(schedule, df.filled).alias("t")).collect():
        xs = np.linspace(0, r.t, 20001)
        ys = np.interp(xs, *zip(*schedule))
        area = float(((ys[1:] + ys[:-1]) / 2 * np.diff(xs)).sum())
        assert abs(area - r.filled) < 1e-6
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (1.0, -1.0)), ((0.0, 1.0), (0.5, 1.0))):
        with pytest.raises(ValueError):
            curriculum.segments(bad)
