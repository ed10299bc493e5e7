"""Columns of a caller's table out of the way of an operator's own names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 250


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of so many rows at most: Spark's
    usual ten thousand would be gigabytes of long texts. A lower setting stays."""
    now = int(spark.conf.get(BATCH_SETTING, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with numbered column names, and the number of each name."""
    inner = {name: f"__c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*inner.values()), inner


def show(df: DataFrame, inner: dict[str, str]) -> DataFrame:
    """Only the columns that ``hide`` renamed, under their own names."""
    return df.select(*[F.col(i).alias(name) for name, i in inner.items()])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
