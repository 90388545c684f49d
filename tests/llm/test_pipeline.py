"""The pipeline's stages against what each operator says of its input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from restock.llm import dart_minhash, decontaminate, language_id, secret_scan
from restock.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], FOLDER)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_keeps_clean_documents(steps):
    assert len(ids(steps[1])) >= 0.98 * len(ids(steps[0]))


def test_near_dedup_keeps_one_of_each_class(steps):
    got = dart_minhash.classes(steps[1]).collect()
    assert ids(steps[2]) == sorted({r.class_id for r in got})


def test_decontamination_removes_affected_documents(spark, steps):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    windows = set()
    for r in benchmark:
        w = decontaminate.split_words(r.text.encode())
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    clean = []
    for r in steps[2].collect():
        w = decontaminate.split_words(r.text.encode())
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append(r.doc_id)
    assert ids(steps[3]) == sorted(clean)


def test_secrets_are_replaced(steps):
    assert ids(steps[4]) == ids(steps[3])
    for r in steps[4].collect():
        assert not secret_scan.base_spans(r.text)
        assert r.n_chars == len(r.text)


def test_packing_holds_every_id(spark, steps):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: np.array([*encoder.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in steps[4].collect()}
    rows = steps[5].collect()
    assert all(zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))


def test_stages_on_an_empty_table(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_stages_keep_extra_columns(spark):
    names = ("_row", "row", "label", "rejected", "node", "spans")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for n in names:
        docs = docs.selectExpr("*", f"1 as {n}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, FOLDER))
        assert after.columns == docs.columns
        docs = after


def test_letterless_texts_go_without_models(spark):
    rows = [(1, "some words"), (2, "123 ..."), (3, None), (4, ""), (5, "é 1")]
    docs = spark.createDataFrame([(k, x, None) for k, x in rows], "doc_id long, text string, lang string")
    assert ids(corpus_pipeline.language(spark, docs, FOLDER)) == [1, 5]


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k, "some words in a text", f"l{k}") for k in range(30)], "doc_id long, text string, lang string")
    assert language_id.learn(docs, F.lit(True)).languages == sorted(f"l{k}" for k in range(30))
