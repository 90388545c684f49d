"""From raw documents to packed training windows, stage by stage.

Each stage reads what its predecessor kept; all but the last keep the columns of ``documents``. A stage's
result is written to the shared folder before the next one starts, so a lost executor costs at most one stage.

language     documents whose language is rejected (no letters, or unlike every learned language) go
near_dedup   one document of each near-duplicate class stays
decontaminate  documents that hold a benchmark window go
secrets      secrets are replaced by a mark, all documents stay
packing      the texts as token windows
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restock.llm import dart_minhash, decontaminate, language_id, packing, secret_scan
from restock.llm.common import fold, table, with_rows
from restock.session import cut_lineage

#: documents that a worker is sent at once: whole texts may be long
BATCH_DOCUMENTS = 2_000


def small_batches(stage):
    """``stage`` with at most BATCH_DOCUMENTS rows in an Arrow batch, which bounds the memory of executors and workers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = language_id.learn(docs, fold(F.col("doc_id"), 5) != 0)
    if not models.languages:
        # nothing to learn from, so only texts without a letter are rejected
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    numbered, row = with_rows(docs)
    judged = language_id.predict(numbered, models, keep=(row,)).where("rejected").select(row)
    return numbered.join(cut_lineage(judged), row, "left_anti").drop(row)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.deduplicate(docs)


@small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    clean = secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return clean


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("secrets", secrets),
    ("packing", pack),
]

#: models, sketches and token ids are beyond SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
