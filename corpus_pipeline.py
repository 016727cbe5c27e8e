"""A corpus pipeline over documents: filters, near-duplicates, secrets and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import packing, quality, secrets, simhash, toxicity
from tallybook.llm.common import dropped, saved, table, tidied
from tallybook.llm.entries import vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.learnt(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.accepted(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.deduplicated(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their texts replaced."""
    return secrets.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("secrets", secret_redaction),
    ("packing", sequence_packing),
]

#: The classifiers and tokenizers of its stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before has written; a stage's input and its own tables go once its result is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with tidied(spark):
            docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
