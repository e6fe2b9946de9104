"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from inkmeter.llm import bpe, mixing, ngram_join, secret_scan, toxicity
from inkmeter.llm.common import Table
from inkmeter.session import hand_back, ship


def stage(function):
    """A stage (spark, docs, sf_dir) that has the package at its workers and bounded batches.

    What the driver no longer uses of the stage before goes back to the system first.

    All stages take rows as they come: texts may be null, empty or long, rows
    repeated, ids null, the table empty, and columns beside those of documents
    stay and may have any name.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hand_back(spark)
        return function(ship(spark), docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects. Null and empty texts score as texts without words and stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five-word shingles, 0.8).

    Texts without words are nobody's copy; rows with a null doc_id stay.
    """
    return ngram_join.deduplicated(docs)


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps every document. Null texts stay null."""
    return secret_scan.redacted(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the sources down to the production weights. Null sources and languages are names of their own."""
    return mixing.mixed_once(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ("ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: Trained models and the hash orders are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again.

    A stage's table is deleted once the next one is written; the last one stays
    for its reader.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, function) in enumerate(STAGES):
        made = Table(function(spark, docs, sf_dir), f"pipeline-{number}-{name}")
        if before:
            before.drop()
        docs, before = made.rows, made
    return docs
