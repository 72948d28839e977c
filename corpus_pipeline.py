"""A corpus pipeline of five stages over ``documents``.

Language identification drops what has no language, near copies are reduced to one document a group, documents that
hold benchmark items go, the sources are mixed to their weights (documents repeat), and the rest is written as token-id files
and read back. Each stage works on all rows its predecessor kept, takes any extra columns along, and returns documents; the
last returns doc_id, start, n_tokens and ids_crc32 of every stored document. Empty tables pass through.

Stages that read texts in Python get them in batches of bounded bytes: an executor keeps buffers of the largest batch for each
task, stage after stage, in the JVM and in its workers. A session that sets ``BATCH_BYTES`` itself keeps its value.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm import decontaminate, language, mixing, simhash, token_files
from haulmark.session import pinned, scratch_path

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = "2m"


def bounded(stage):
    """The stage, with batches of ``TEXT_BATCH`` in a session that names no size."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, TEXT_BATCH)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs, language.train(docs))


@bounded
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@bounded
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "corpus-tokens")
    token_files.write_token_files(docs, folder)
    return token_files.stored_documents(docs, folder)


STAGES = [
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token files", token_stage),
]

# Language identification, fingerprints and tokenizers have no SQL form; tests/llm compares run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
    return docs
