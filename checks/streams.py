"""Tables that arrive in pieces."""

from pyspark.sql import functions as F

from checks.common import DIRTY, DUPS, TEXTS, check, dirty, dups, table, texts
from sparktidy.operators.impute import fit_fill
from sparktidy.operators.repair import clean_text
from sparktidy.operators.validate import ColumnSchema, DataSchema
from sparktidy.session import work_folder
from sparktidy.streaming import streams


def _stream(spark, df, batches=4):
    """The table written in pieces and read back as a stream. A batch has as many
    pieces as a quarter of the table needs, one for each that a scan would read."""
    path = work_folder(spark, "stream-input")
    per_batch = -(-df.rdd.getNumPartitions() // batches)
    df.repartition(batches * per_batch).write.parquet(path)
    return streams.read_stream(spark, path, df.schema, files_per_batch=per_batch)


@check("stream_counts", "SELECT CAST(count(*) AS BIGINT) AS total FROM events")
def stream_counts(spark, d):
    return streams.stream_counts(_stream(spark, table(spark, d, "events"))).agg(F.sum("rows").alias("total"))


@check("stream_clean", f"WITH {TEXTS} SELECT doc_id, " + r"regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+', ' ', 'g')"
       + " AS text FROM texts")
def stream_clean(spark, d):
    return streams.stream_table(clean_text(_stream(spark, texts(spark, d))))


@check("stream_fill", f"""WITH {DIRTY} SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty)) AS value FROM dirty""")
def stream_fill(spark, d):
    model = fit_fill(dirty(spark, d), "median", ["value"])
    return streams.stream_table(model.transform(_stream(spark, dirty(spark, d))).select("event_id", "value"))


@check("stream_dedup", f"WITH {DUPS} SELECT DISTINCT event_id, user_id, event_type, value, props FROM dups")
def stream_dedup(spark, d):
    days = F.date_diff(F.max("ts"), F.min("ts")) + 1
    delay = table(spark, d, "events").agg(days).first()[0]
    unique = streams.stream_dedup(_stream(spark, dups(spark, d)), ["event_id"], "ts", f"{delay} days")
    return streams.stream_table(unique).drop("ts")


@check("stream_validation", f"""WITH {DIRTY} SELECT 'event_type' AS "column", 'nullable' AS "check", 'error' AS severity,
  CAST(count(*) - count(event_type) AS BIGINT) AS nulls FROM dirty""")
def stream_validation(spark, d):
    schema = DataSchema([ColumnSchema("event_type", nullable=False), ColumnSchema("event_id", nullable=False)])
    found = streams.stream_validation(_stream(spark, dirty(spark, d)), schema)
    return found.groupBy("column", "check", "severity").agg(F.sum(F.col("actual").cast("bigint")).alias("nulls"))
