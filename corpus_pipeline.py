"""From raw documents to encoded training data, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written
and read back before the next one, so a stage never repeats an earlier one's work
after a lost executor. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparktidy.llm import bpe, hostrules, mixing, ngramjoin, secrets
from sparktidy.session import materialize

#: The mixing schedule, the hashed shuffle order and the encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host is rejected, go."""
    return hostrules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word similarity of 0.8 or more, one stays."""
    return ngramjoin.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking values of few owners are masked in the text."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources come near their weights."""
    return mixing.mix_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans),
          ("mixing_sources", mixing_sources), ("bpe_encoding", bpe_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
