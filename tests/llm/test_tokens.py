"""Token ids, packing, token files and token counts against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from restock.llm import id_files, packing, token_counts, word_ids
from restock.llm.word_ids import WordIds
from restock.session import staging_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, held string"
TEXTS = [None, "", "a", "Hello World, it's 12 o'clock", "hello " * 9000, "É l'été\n\n\nç", "a", "<|endoftext|> x", "x\x1cy\x85z"]


@pytest.fixture(scope="module")
def encoder():
    return WordIds(WORDS)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "y")], DOCS)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text("aAzZéÉ'ſstİΣς \n\t\x0b\x1c\x85.,!09²٣中が̸́=<>|—…»🙂ﬁ", max_size=15))
def test_ids_equal_the_library(text):
    encoder = test_ids_equal_the_library.__dict__.setdefault("encoder", WordIds(WORDS))
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode([text.encode()])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def expected(encoder, text, end):
    return np.array([*encoder.library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pack_places_every_id_once():
    rng = random.Random(4)
    for n, most in ((1, 1), (3, 50), (40, 3000), (400, 4000), (900, 200), (20, 20000)):
        lengths = [rng.randint(1, most) for _ in range(n)]
        pieces = defaultdict(list)
        padding = 0
        for sequence in packing.pack(lengths):
            size = sum(p[2] for p in sequence)
            assert 0 < size <= 4096
            padding += 0 if size & (size - 1) == 0 else 4096 - size
            for d, start, length in sequence:
                pieces[d].append((start, length))
        for d, n_ids in enumerate(lengths):
            at = 0
            for start, length in sorted(pieces[d]):
                assert start == at and length > 0
                at += length
            assert at == n_ids
        assert padding <= 0.02 * sum(lengths)


def test_differencing_levels_the_sets():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(600)]
    sets = packing.multiway_differencing(sizes, 20)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(600))
    assert max(sums) - min(sums) <= 8
    assert packing.multiway_differencing([], 2) == [[], []]
    assert sorted(map(len, packing.multiway_differencing([5], 3))) == [0, 0, 1]


def test_packing_query(spark, docs, encoder):
    rows = packing.pack_documents(docs.repartition(2), tokenizer=WORDS).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    texts = dict(enumerate(TEXTS)) | {None: "null id"}
    for r in rows:
        ids = expected(encoder, texts[r.doc_id], 2)
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for spans in [*sequences.values(), *pieces.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert set(pieces) == set(texts)
    assert packing.pack_documents(docs.limit(0), tokenizer=WORDS).count() == 0


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([0, 1, 1, 2, 4, 8, 16, 32, 64, 1000])
    lengths = id_files.code_lengths(counts, 18)
    assert lengths[0] == 0 and sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    assert (lengths * counts).sum() == 1000 + 2 * 64 + 3 * 32 + 4 * 16 + 5 * 8 + 6 * 4 + 7 * 2 + 8 * 2
    short = id_files.code_lengths(counts, 4)
    assert short.max() == 4 and sum(2.0 ** -int(x) for x in short if x) <= 1.0
    assert id_files.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    with pytest.raises(ValueError):
        id_files.code_lengths(np.ones(9), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=1500))
def test_codes_round_trip(values):
    ids = np.array(values)
    codes = id_files.Codes(id_files.code_lengths(np.bincount(ids)))
    bits, checkpoints = codes.encode(ids)
    words = np.append(np.frombuffer(bits, ">u8"), np.zeros(2, ">u8")).astype(np.uint64)
    sizes = np.minimum(id_files.STEP, len(ids) - id_files.STEP * np.arange(len(checkpoints)))
    assert codes.decode(words, checkpoints, sizes).tolist() == values


def test_token_files_round_trip(spark, docs, encoder, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_IDS", 500)
    path = staging_path(spark, "ids")
    id_files.write_ids(docs.repartition(3), path, WORDS)
    got = sorted(map(tuple, id_files.read_ids(spark, path).collect()), key=lambda r: (r[0] is not None, r[0]))
    at, want = 0, []
    for doc_id, text in [(None, "null id"), *enumerate(TEXTS)]:
        ids = expected(encoder, text, 1)
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = staging_path(spark, "ids")
    id_files.write_ids(docs.limit(0), path, WORDS)
    assert id_files.read_ids(spark, path).count() == 0


def test_sections_add_up_to_the_document(spark, docs):
    rows = token_counts.count_tokens(docs, BYTES).collect()
    counter = token_counts.Counter(BYTES)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {None, *range(len(TEXTS))}
    for doc_id, sections in by_doc.items():
        text = "null id" if doc_id is None else TEXTS[doc_id] or ""
        tokens = counter.encoding.encode_ordinary(text)
        sections.sort(key=lambda r: r.section)
        assert sum(r.n_tokens for r in sections) == len(tokens) == sections[0].doc_tokens
        assert abs(sum(r.token_share for r in sections) - len(tokens)) < 1e-9
        parts = text.split("\n")
        lines = [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
        assert [text[r.start : r.end] for r in sections] == lines
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("rule", ["majority", "start", "end"])
def test_crossing_tokens_follow_the_rule(rule):
    counter = token_counts.Counter(BYTES)
    for text in ("a\n\n\n\nb", "x \n\n  y\n", "\n\n\n", "é\n\nü\r\n\r\n"):
        raw, at, spans = text.encode(), 0, []
        for t in counter.encoding.encode_ordinary(text):
            n = len(counter.encoding.decode_single_token_bytes(t))
            spans.append((at, at + n))
            at += n
        owner, line = [], 0
        for byte in raw:
            owner.append(line)
            line += byte == 10
        want = defaultdict(int)
        for s, e in spans:
            held = owner[s:e]
            best = max(sorted(set(held)), key=held.count)
            want[{"majority": best, "start": held[0], "end": held[-1]}[rule]] += 1
        got = counter.sections(text, rule)[2]
        assert {k: int(v) for k, v in enumerate(got) if v} == dict(want)


def test_the_chunk_cache_is_bounded(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    encoder = word_ids.WordIds(WORDS)
    letters = [bytes([97 + k % 26, 97 + k // 26 % 26, 97 + k // 676 % 26, 97 + k // 17576]) for k in range(600_000 // 2)]
    for ending in (b"", b"x"):
        for lo in range(0, len(letters), 50_000):
            encoder.encode([b" ".join(w + ending for w in letters[lo : lo + 50_000])])
    assert len(encoder.known) <= 550_000  # 600,000 words, a step of 50,000 beyond the limit at most
    # long chunks count by their ids; what is used again and again stays right
    monkeypatch.setattr(word_ids, "CACHE_IDS", 4_000, raising=False)
    encoder = word_ids.WordIds(WORDS)
    for k in range(60):
        texts = [f"again {k}{'abc0' * 100} {w}" for w in ("again", "many-words", "café")]
        got = encoder.encode([x.encode() for x in texts])
        assert [x.tolist() for x in got] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(encoder.sizes[: len(encoder.known)]) <= 4_000 + 2_000
