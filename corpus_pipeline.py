"""A cleaning pipeline over `documents`: each stage works on what the one before kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir).  All
but the last return the columns of documents, so any prefix can be run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.llm import common, exact_dedup, ngram_join, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line labelling or a base rule rejects."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect, the smallest identifier stays."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; `n_chars` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; one row per piece."""
    return packing.pack(packing.with_crc(packing.pieces(docs)))


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", packed),
]

#: A linear-chain model and a search decide, which SQL does not express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read back."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
