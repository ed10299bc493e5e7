"""Applying the operators to a table that arrives in pieces."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparktidy.operators.validate import DataSchema, violations
from sparktidy.session import work_folder


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """A file stream with a declared schema, a bounded number of files at a time."""
    return (spark.readStream.format(format).schema(schema)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process everything available in batches, then stop. Restarting with the
    same checkpoint continues after the last finished batch."""
    query = (stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint or work_folder(stream.sparkSession, "stream-checkpoint"))
             .start())
    query.awaitTermination()


def _per_batch(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], purpose: str) -> DataFrame:
    """Run ``summarise`` on each batch into a table keyed by batch id. A replayed
    batch overwrites its own folder, so retries do not double count."""
    spark = stream.sparkSession
    folder = work_folder(spark, purpose)
    shape: list[T.StructType] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = summarise(batch)
        shape[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    drain(stream, handle)
    if not shape:
        return summarise(spark.createDataFrame([], stream.schema)).withColumn("batch_id", F.lit(0)).limit(0)
    schema = T.StructType([*shape[0].fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)


def stream_counts(stream: DataFrame) -> DataFrame:
    """Rows per batch."""
    return _per_batch(stream, lambda b: b.agg(F.count("*").alias("rows")), "stream-counts")


def stream_validation(stream: DataFrame, schema: DataSchema) -> DataFrame:
    """Violations found in each batch."""
    return _per_batch(stream, lambda b: violations(b, schema), "stream-violations")


def stream_table(stream: DataFrame) -> DataFrame:
    """Write a (transformed) stream to a Parquet table and return the table."""
    spark = stream.sparkSession
    folder, checkpoint = work_folder(spark, "stream-table"), work_folder(spark, "stream-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).option("path", folder).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def stream_dedup(stream: DataFrame, columns: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats that arrive within ``delay``. State is dropped as the
    watermark passes, so it does not grow with the stream."""
    timed = stream
    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)
