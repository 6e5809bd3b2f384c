"""From raw documents to packed training sequences: five stages, each a Spark job over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of ``documents``. Stages are written as Parquet to the shared folder and read again, so
that a lost executor costs at most the stage that runs.

Defined cases: null, empty and blank texts fail the base rules of the first stage and go; rows that repeat an id with
the same text stay together or go together in every stage, and are packed once each; a row with a null id is linked with nothing,
loses no passage and is packed under a null id; empty tables give an empty result; further columns travel with
their rows up to packing, whatever their names. Without labels of both kinds the base rules alone decide.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmattan.llm import op1_surrogates, op4_quality, op5_packing, op9_substrings, op10_jaccard
from harmattan.llm.common import table
from harmattan.session import materialize

SURROGATE_KEY = "surrogates of the corpus pipeline"


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars brought up to date after a change of the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated classifier stay."""
    return op4_quality.filter_documents(docs, op4_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays; rows with a null id stay."""
    groups = op10_jaccard.join(docs)
    gone = materialize(groups.filter("doc <> component_id").select(F.col("doc").alias("doc_id")))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has too are cut out."""
    return _measured(op9_substrings.remove(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    return _measured(op1_surrogates.replace(docs, key=SURROGATE_KEY, count_col=None))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of at most 2048."""
    return op5_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("pii surrogates", private_data),
    ("best-fit packing", packing),
]

#: SQL cannot express the stages; the tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
