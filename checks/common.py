"""Registry of queries with their DuckDB twins, and the shared inputs.

The given tables hold no nulls, copies or stray blanks, so the inputs below
inject them by rule, over all rows, with the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(key: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin, or None where SQL cannot say it."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the continuous columns, so summation order does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


DIRTY = """dirty AS (
  SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""
DUPS = DIRTY + """, dups AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE event_id % 13 = 0)"""
SPIKY = """spiky AS (
  SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 101 = 0 THEN value * 50 ELSE value END
         AS value FROM events)"""
TEXTS = """texts AS (
  SELECT doc_id, '  ' || CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', '  ') ELSE text END || chr(9) || ' ' AS text
  FROM documents)"""


def dirty(spark, folder) -> DataFrame:
    """Events with nulls in ``value`` and ``event_type``."""
    return (table(spark, folder, "events")
            .withColumn("event_type", F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"))
            .withColumn("value", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")))


def dups(spark, folder) -> DataFrame:
    """Dirty events with some rows twice, in one scan."""
    twice = F.expr("CASE WHEN event_id % 13 = 0 THEN array(0, 1) ELSE array(0) END")
    return dirty(spark, folder).withColumn("__copy", F.explode(twice)).drop("__copy")


def spiky(spark, folder) -> DataFrame:
    """Events with nulls and a few inflated values."""
    return table(spark, folder, "events").select("event_id", "user_id", F.expr(
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 101 = 0 THEN value * 50 ELSE value END").alias("value"))


def texts(spark, folder) -> DataFrame:
    """Documents with stray blanks around and inside the text."""
    return table(spark, folder, "documents").select("doc_id", F.expr(
        "concat('  ', CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', '  ') ELSE text END, '\\t', ' ')").alias("text"))


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
