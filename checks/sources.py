"""Loading, saving and chunking."""

from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, functions as F

from checks.common import check, table
from sparktidy.session import work_folder
from sparktidy.sources import files, footers

# Chunks summed up by one job, so that no plan grows with the table.
CHUNKS_A_PLAN = 32
EVENTS_OUT = "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events"


def _events_out(df):
    return df.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                     "user_id", "event_type", "value", "props")


@check("load_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def load_parquet(spark, d):
    return files.load_data(spark, f"{d}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@check("csv_roundtrip", EVENTS_OUT)
def csv_roundtrip(spark, d):
    df, path = table(spark, d, "events"), work_folder(spark, "events") + ".csv"
    files.save_data(df, path)
    return _events_out(files.load_data(spark, path, schema=df.schema))


@check("csv_inferred", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, d):
    df, path = table(spark, d, "customer"), work_folder(spark, "customer") + ".csv"
    files.save_data(df, path, sep="|")
    return files.load_data(spark, path, sep="|").withColumns(
        {c: F.col(c).cast("bigint") for c in ("c_custkey", "c_nationkey")})


@check("json_roundtrip", EVENTS_OUT)
def json_roundtrip(spark, d):
    df, path = table(spark, d, "events"), work_folder(spark, "events") + ".jsonl"
    files.save_data(df, path)
    return _events_out(files.load_data(spark, path, schema=df.schema))


@check("json_roundtrip_json", EVENTS_OUT)
def json_roundtrip_json(spark, d):
    df, path = table(spark, d, "events"), work_folder(spark, "events") + ".json"
    files.save_data(df, path)
    return _events_out(files.load_data(spark, path, schema=df.schema))


@check("convert_to_json", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def convert_to_json(spark, d):
    first, path = work_folder(spark, "part") + ".csv", work_folder(spark, "part") + ".json"
    files.save_data(table(spark, d, "part"), first, sep=";")
    files.convert_format(spark, first, path, read_options={"sep": ";"})
    return files.load_data(spark, path).select(
        "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")


@check("csv_newlines", """SELECT doc_id, replace(replace(text, 'e', chr(10)), 'a', '",' || chr(13) || chr(10)) AS text, lang
       FROM documents""")
def csv_newlines(spark, d):
    df, path = table(spark, d, "documents"), work_folder(spark, "documents") + ".csv"
    text = F.replace(F.replace("text", F.lit("e"), F.lit("\n")), F.lit("a"), F.lit('",\r\n'))
    files.save_data(df.select("doc_id", text.alias("text"), "lang"), path)
    return files.load_data(spark, path, schema="doc_id long, text string, lang string")


@check("parquet_roundtrip", EVENTS_OUT)
def parquet_roundtrip(spark, d):
    df, path = table(spark, d, "events"), work_folder(spark, "events") + ".parquet"
    files.save_data(df, path, compression="zstd")
    return _events_out(files.load_data(spark, path))


@check("partitioned_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def partitioned_roundtrip(spark, d):
    df, path = table(spark, d, "part"), work_folder(spark, "part") + ".parquet"
    files.save_data(df, path, partition_by=["p_brand"])
    return files.load_data(spark, path).select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@check("convert_format", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def convert_format(spark, d):
    path = work_folder(spark, "part") + ".jsonl"
    files.convert_format(spark, f"{d}/part.parquet", path)
    return files.load_data(spark, path).select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@check("peek", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def peek(spark, d):
    return files.peek(spark, f"{d}/events.parquet", order_by=["event_id"]).select(
        "event_id", "user_id", "event_type", "value")


@check("file_info", """SELECT 'parquet' AS format, 6::BIGINT AS n_columns,
       'event_id,ts,user_id,event_type,value,props' AS columns, count(*) AS n_rows FROM events""")
def file_info(spark, d):
    return files.table_info(spark, f"{d}/events.parquet").select(
        "format", F.col("n_columns").cast("bigint").alias("n_columns"), "columns", "n_rows")


@check("footer_facts", "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", count(*) AS n_values, CAST(count(*) - count({c}) AS BIGINT) AS n_nulls,
       CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high FROM events""" for c, low, high in [
    *[(c, f"min({c})", f"max({c})") for c in ("event_id", "user_id", "value")], ("ts", "epoch_us(min(ts))", "epoch_us(max(ts))"),
    *[(c, "NULL", "NULL") for c in ("event_type", "props")]]))
def footer_facts(spark, d):
    return footers.column_facts(spark, f"{d}/events.parquet").drop("position")


@check("csv_estimate", "SELECT 'events' AS name, CAST(count(*) AS BIGINT) AS n_rows, true AS near FROM events")
def csv_estimate(spark, d):
    path = work_folder(spark, "events") + ".csv"
    files.save_data(table(spark, d, "events"), path)
    near = F.abs(F.lit(files.estimate_rows(spark, path)) / F.col("n_rows") - 1) < 0.05
    return files.table_info(spark, path).select(F.lit("events").alias("name"), "n_rows", near.alias("near"))


@check("chunk_rows", """SELECT event_id, ts, user_id, event_type, value, props, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS chunk_id
       FROM events""")
def chunk_rows(spark, d):
    """Over many files of several row groups, cut elsewhere than the chunks are."""
    path = work_folder(spark, "events") + ".parquet"
    table(spark, d, "events").repartitionByRange(7, "event_id").sortWithinPartitions("event_id").write.option(
        "parquet.block.size", 64 * 1024).option("parquet.page.size", 8 * 1024).parquet(path)
    return footers.read_chunks(spark, path, 1000)


@check("stream_chunks", """SELECT CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS chunk, count(*) AS n_rows, min(event_id) AS first_id,
       max(event_id) AS last_id, round(sum(value), 6) AS total FROM events GROUP BY CAST(floor(event_id / 8192) AS BIGINT)""")
def stream_chunks(spark, d):
    chunks = files.FastDataLoader(spark).stream_chunks(f"{d}/events.parquet", chunk_size=8192)
    facts = (c.agg(F.lit(i).cast("long").alias("chunk"), F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"),
                   F.max("event_id").alias("last_id"), F.round(F.sum("value"), 6).alias("total")) for i, c in enumerate(chunks))
    folder = work_folder(spark, "chunk-facts")
    while some := list(islice(facts, CHUNKS_A_PLAN)):
        reduce(DataFrame.unionByName, some).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


@check("chunk_ids", """SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS chunk_id
       FROM events""")
def chunk_ids(spark, d):
    return files.with_chunk_ids(table(spark, d, "events").select("event_id"), ["event_id"], 1000)
