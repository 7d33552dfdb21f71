"""From raw documents to token digests: toxicity, exact dedup, near dedup, mixing and byte-level BPE.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Null columns, empty and very long texts, ties, repeated rows and empty tables are handled as the operators say: null
counts as empty text, which is neither toxic nor a near duplicate; of empty texts, as of all equal ones, one row stays;
a null id is the smallest. Columns that documents has besides are carried to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from stowage.llm._common import dropped, table, written
from stowage.llm.queries import byte_vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.distinct_rows(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8), the document with the smallest doc_id."""
    return near_dup.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those it doesn't take go."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.round_trip(docs, byte_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Neither the chain's models nor BPE can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # nothing reads the stage before any more
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")
