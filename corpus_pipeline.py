"""The corpus pipeline: documents to token ids in five written stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, cotrain, mixing, pii, simhash
from tesserae.llm.common import drop_staged, pii_key, read, staged


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return cotrain.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: verified Jaccard 0.8 or more of five-word shingles."""
    return simhash.dedup(docs, shingle=5, least=0.8)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced."""
    return _counted(pii.pseudonymise(docs, pii_key(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights."""
    return _counted(mixing.take(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again for their check sum."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", surrogates), ("mix", mix), ("tokens", tokens)]

#: Classifier, fingerprints and tokenizer are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole table of documents."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # nothing reads it any more
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
