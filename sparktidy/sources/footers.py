"""Parquet footers as tables, and rows read by their number in a table.

The order of rows is that of the files: by path, then as they stand in the file.
Footers are read by tasks, many files at once; the rows of a row group are read by
the task that holds it, so nothing is rewritten and a lost task reads again.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparktidy.errors import DataValidationError
from sparktidy.plans.ordering import running_total

CHUNK = "chunk_id"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: how a folder name spells null
BATCH_ROWS = 8192
TASK_BYTES = 128 * 1024 * 1024
#: Rows ``from`` to before ``to`` of the table, which lie in one row group.
PIECE = T.StructType().add("path", "string").add("row_group", "integer").add("first_row", "long").add("from", "long").add("to", "long")


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files, as Spark lists them; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(path))
    return files.where(F.col("length") > 0).select("path")


def can_open(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read parts of the files themselves. A store that only
    Spark's own readers know has no footers here."""
    first = _listed(spark, path).head(1)
    try:
        return not first or _opened(first[0]["path"])[0] is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _over_files(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """``read(path, metadata)`` yields the rows of one file's footer."""
    names = T.StructType.fromDDL(schema).names

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                system, inner = _opened(file)
                with system.open_input_file(inner) as source:
                    yield pd.DataFrame(list(read(file, pq.read_metadata(source))), columns=names)

    spread = _listed(spark, path).repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInPandas(footers, schema)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row per row group: file, number of the group, rows and bytes."""

    def read(file: str, meta: pq.FileMetaData):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            yield file, g, group.num_rows, group.total_byte_size

    return _over_files(spark, path, read, "path string, row_group int, n_rows long, n_bytes long")


def _number(value: Any) -> float | None:
    """A bound as a number: dates and times in microseconds since 1970."""
    if isinstance(value, datetime.datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
        since = aware - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
        return float((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds)
    if isinstance(value, datetime.date):
        return float((value - datetime.date(1970, 1, 1)).days * 86_400_000_000)
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return float(value)
    return None


def column_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per column, from the footers alone: values (nulls included), nulls,
    and bounds of numbers, dates and times (times as microseconds since 1970). What
    a footer leaves out is null, and so are the bounds of texts and other types.
    Values of a nested column are its leaves, under their full path."""

    def read(file: str, meta: pq.FileMetaData):
        for g in range(meta.num_row_groups):
            for j in range(meta.num_columns):
                part = meta.row_group(g).column(j)
                facts = part.statistics
                nulls = facts.null_count if facts is not None and facts.has_null_count else None
                empty = nulls is not None and nulls == part.num_values
                known = facts is not None and facts.has_min_max
                low, high = (_number(facts.min), _number(facts.max)) if known else (None, None)
                yield part.path_in_schema, j, part.num_values, nulls, low, high, empty or low is not None

    facts = _over_files(spark, path, read, "column string, place int, n long, nulls long, low double, high double, bound boolean")
    bounded = F.bool_and("bound")
    return facts.groupBy("column").agg(
        F.min("place").alias("position"), F.sum("n").alias("n_values"),
        F.when(F.count("nulls") == F.count("*"), F.sum("nulls")).alias("n_nulls"),
        F.when(bounded, F.min("low")).alias("low"), F.when(bounded, F.max("high")).alias("high"))


def numbered_groups(spark: SparkSession, path: str) -> DataFrame:
    """The row groups with the number of their first row in the table, from 0."""
    total = running_total(row_groups(spark, path), F.col("n_rows"), ["path", "row_group"], "__end")
    return total.withColumn("first_row", F.col("__end") - F.col("n_rows")).drop("__end")


def _column(data: pa.RecordBatch, field: pa.Field, path: str) -> pa.Array:
    """A column of a file as the table has it: stored, named by a folder, or null."""
    at = data.schema.get_field_index(field.name)
    if at >= 0:
        return data.column(at).cast(field.type)
    named = [unquote(part.split("=", 1)[1]) for part in path.split("/")[:-1] if part.split("=", 1)[0] == field.name and "=" in part]
    if not named or named[-1] == NO_VALUE:
        return pa.nulls(len(data), field.type)
    return pa.array([named[-1]] * len(data), pa.string()).cast(field.type)


def _reader(schema: T.StructType, size: int):
    """Rows of the given row groups, ``from`` to before ``to``, with their chunk."""
    wanted = to_arrow_schema(schema)
    dotted = any("." in f.name for f in schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([*wanted, pa.field(CHUNK, pa.int64())])
        for batch in batches:
            for part in batch.to_pylist():
                system, inner = _opened(part["path"])
                with system.open_input_file(inner) as source:
                    file = pq.ParquetFile(source)
                    stored = None if dotted else [n for n in file.schema_arrow.names if n in wanted.names]
                    at = part["first_row"]
                    for data in file.iter_batches(BATCH_ROWS, row_groups=[part["row_group"]], columns=stored):
                        low, high = max(part["from"] - at, 0), min(part["to"] - at, len(data))
                        if low < high:
                            piece = data.slice(low, high - low)
                            chunk = pa.array(np.arange(at + low, at + high) // size)
                            yield pa.RecordBatch.from_arrays(
                                [*[_column(piece, f, part["path"]) for f in wanted], chunk], schema=target)
                        at += len(data)
                        if at >= part["to"]:
                            break

    return read


def chunked(groups: DataFrame, schema: T.StructType, size: int) -> DataFrame:
    """The rows of a table by its ``numbered_groups`` with their ``chunk_id``, row
    groups spread by bytes."""
    if size < 1:
        raise DataValidationError("a chunk has one row at least")
    size_of = groups.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).first()
    tasks = min(max(-(-(size_of["bytes"] or 0) // TASK_BYTES), groups.sparkSession.sparkContext.defaultParallelism),
                max(size_of["n"], 1))
    end = F.col("first_row") + F.col("n_rows")
    plan = groups.withColumn("from", F.col("first_row")).withColumn("to", end).repartition(tasks, "path", "row_group")
    return _read(plan.where("n_rows > 0").select(*PIECE.names), schema, size)


def _read(pieces: DataFrame, schema: T.StructType, size: int) -> DataFrame:
    return pieces.mapInArrow(_reader(schema, size), T.StructType([*schema.fields, T.StructField(CHUNK, T.LongType())]))


def chunk_tables(groups: DataFrame, schema: T.StructType, size: int) -> Iterator[DataFrame]:
    """One table per chunk, in order, by the table's ``numbered_groups``. The driver
    walks along the row groups and holds those of one chunk. A chunk is a list of
    pieces in the plan itself, one task each and in order: nothing is searched or
    sorted for it, and a union of chunks does not run them all in one task, as it
    does with tables of a single partition by plan."""
    if size < 1:
        raise DataValidationError("a chunk has one row at least")
    spark, pieces = groups.sparkSession, []  # at most as many pieces as a chunk has rows

    def table() -> DataFrame:
        return _read(spark.createDataFrame(pa.Table.from_pylist(pieces, schema=to_arrow_schema(PIECE))), schema, size)

    for group in groups.where("n_rows > 0").orderBy("first_row").toLocalIterator():
        at, ends = group["first_row"], group["first_row"] + group["n_rows"]
        while at < ends:
            to = min(ends, (at // size + 1) * size)
            pieces.append({**{c: group[c] for c in PIECE.names[:3]}, "from": at, "to": to})
            if to % size == 0:
                yield table()
                pieces = []
            at = to
    if pieces:
        yield table()


def read_chunks(spark: SparkSession, path: str, size: int, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with the ``chunk_id`` of every row: rows in file order, cut
    every ``size`` rows. Only the named columns are read."""
    table = spark.read.parquet(str(path))
    schema = table.schema if columns is None else T.StructType([table.schema[c] for c in columns])
    if CHUNK in schema.names:
        raise DataValidationError(f"the table already has a column {CHUNK}")
    return chunked(numbered_groups(spark, path), schema, size)
