"""Reading and writing tables."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparktidy.config import get_config
from sparktidy.errors import DataLoadError, ExportError, UnsupportedOperationError
from sparktidy.functions.exprs import col, format_bytes
from sparktidy.plans.ordering import row_numbers
from sparktidy.session import materialize, work_folder
from sparktidy.sources import csvrecords, footers

# File name endings and the formats they stand for.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl"}
# Common names of encodings Spark knows under another name.
ENCODINGS = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "utf8": "utf-8", "ascii": "us-ascii"}
SAVE_FORMATS = ("csv", "parquet", "json")
SAVE_MODES = ("error", "overwrite", "append", "ignore")
# Text formats keep microseconds.
WRITTEN_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                 "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CSV_INFER_RATIO = 1.0
ESTIMATE_LINES = 1000


def detect_format(path: str) -> str:
    suffix = PurePosixPath(str(path).rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise UnsupportedOperationError(f"unsupported file type {suffix or path!r}; known: {sorted(FORMATS)}")
    return FORMATS[suffix]


def load_data(
    spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None, **options: Any
) -> DataFrame:
    """A lazy table from CSV, Parquet, JSON (array or object) or JSON lines.

    Declare ``schema`` for large CSV or JSON inputs: inference costs a pass.
    CSV cells that do not parse become null.

    ``json_lines``: True reads one record per line, False whole files (an array,
    or an object over several lines: one task per file). By default the first
    line decides. ``multiLine`` does the same for CSV cells that hold line ends;
    by default one pass looks for quotes that a line leaves open, and if it finds one
    the records are put together by many tasks a file; ``multiLine=True`` has Spark
    read whole files instead.
    """
    json_lines = options.pop("json_lines", None)
    fmt = (format or detect_format(path)).lower()
    config = get_config()
    if "encoding" in options:
        options["encoding"] = ENCODINGS.get(str(options["encoding"]).lower(), options["encoding"])
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        settings = {"header": True, "sep": config.csv_delimiter, "encoding": config.default_encoding,
                    "mode": "PERMISSIVE", "escape": '"'}
        if schema is None:
            settings |= {"inferSchema": True, "samplingRatio": CSV_INFER_RATIO}
        if "multiLine" not in options and _open_quotes(spark, path, options.get("quote", '"')):
            if csvrecords.fits(spark, path, {**settings, **options}):
                return csvrecords.read(spark, path, schema, {**settings, **options})
            settings["multiLine"] = True
        reader, source = reader.options(**{**settings, **options}), "csv"
    elif fmt == "json":
        if "multiLine" not in options:
            options["multiLine"] = not (_one_record_a_line(spark, path) if json_lines is None else json_lines)
        reader, source = reader.options(**options), "json"
    elif fmt == "jsonl":
        reader, source = reader.options(**options), "json"
    elif fmt == "parquet":
        reader, source = reader.options(**options), "parquet"
    else:
        raise UnsupportedOperationError(f"unsupported format {fmt}")
    try:
        return reader.format(source).load(str(path))
    except AnalysisException as error:
        raise DataLoadError(f"cannot load {path}: {error.getMessage() or error}") from error


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(str(path)).where(F.trim("value") != "")
    except AnalysisException as error:
        raise DataLoadError(f"cannot load {path}: {error.getMessage() or error}") from error


def _one_record_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a whole object. Only its ends reach the driver."""
    line = F.trim(F.translate("value", "\t\r\ufeff", "   "))
    ends = _lines(spark, path).select(F.substring(line, 1, 1), F.substring(line, -1, 1)).head(1)
    return not ends or tuple(ends[0]) == ("{", "}")


def _open_quotes(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether a line holds an odd number of quotes, as it does where a cell goes
    on in the next line. Stops at the first one found."""
    if not quote:
        return False
    n = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return bool(_lines(spark, path).where(n % 2 == 1).select(F.lit(1)).head(1))


def scan_lazy(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Every Spark table is lazy; filters and columns reach the scan."""
    return load_data(spark, path, **options)


def peek(spark: SparkSession, path: str, n_rows: int | None = None, order_by: list[str] | None = None,
         **options: Any) -> DataFrame:
    """The first rows; with ``order_by`` the choice is repeatable."""
    df = load_data(spark, path, **options)
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    return df.limit(n_rows or get_config().sample_size)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, size, time of change. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(path))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("last_modified"))


def estimate_rows(spark: SparkSession, path: str, header: bool = True) -> int:
    """About how many records a text file or folder (CSV, JSON lines) holds: its
    bytes over those of a line, taken from the first thousand lines. A file is
    read no further than that; compressed files and lines that differ in length
    along a table make it rougher."""
    size = file_info(spark, path).agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes")).first()
    lines = _lines(spark, path).limit(ESTIMATE_LINES).select((F.octet_length("value") + 1).alias("bytes"))
    seen = lines.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    if not seen["n"]:
        return 0
    heads = size["files"] if header else 0
    if seen["n"] < ESTIMATE_LINES:  # that was all of it
        return max(seen["n"] - heads, 0)
    return max(round(size["bytes"] * seen["n"] / seen["bytes"]) - heads, 0)


def table_info(spark: SparkSession, path: str, format: str | None = None, exact: bool = True) -> DataFrame:
    """One row per table: files, bytes, format, columns and row count. For Parquet
    the count is the footers'; for text formats it is counted, or estimated from
    a thousand lines if ``exact`` is off (arrays in JSON are always counted)."""
    fmt = format or detect_format(path)
    df = load_data(spark, path, format=fmt)
    size = file_info(spark, path).agg(F.count("*").alias("n_files"), F.sum("file_size_bytes").alias("size_bytes"))
    if fmt == "parquet" and footers.can_open(spark, path):
        rows = footers.row_groups(spark, path).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    elif not exact and (fmt in ("csv", "jsonl") or fmt == "json" and _one_record_a_line(spark, path)):
        rows = spark.range(1).select(F.lit(estimate_rows(spark, path, header=fmt == "csv")).cast("long").alias("n_rows"))
    else:
        rows = df.agg(F.count("*").alias("n_rows"))
    return size.withColumn("__one", F.lit(1)).join(
        F.broadcast(rows.withColumn("__one", F.lit(1))), "__one").select(
        "n_files", "size_bytes", F.lit(fmt).alias("format"), F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"), "n_rows")


def save_data(
    df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite",
    partition_by: list[str] | None = None, **options: Any
) -> None:
    """Write a table as CSV, Parquet or JSON lines; one file per task."""
    fmt = (format or detect_format(path)).lower()
    fmt = "json" if fmt == "jsonl" else fmt
    if fmt not in SAVE_FORMATS:
        raise UnsupportedOperationError(f"unsupported format {fmt}; known: {SAVE_FORMATS}")
    if mode not in SAVE_MODES:
        raise UnsupportedOperationError(f"unknown mode {mode}; known: {SAVE_MODES}")
    config = get_config()
    settings: dict[str, Any] = {}
    if fmt == "csv":
        settings = {"header": True, "sep": config.csv_delimiter, "escape": '"', "emptyValue": '""',
                    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **WRITTEN_TIMES}
    if fmt == "json":
        settings = {"ignoreNullFields": False, **WRITTEN_TIMES}
    if config.export_compression:
        settings["compression"] = config.export_compression
    writer = df.write.mode(mode).options(**{**settings, **options})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.format(fmt).save(str(path))
    except AnalysisException as error:
        raise ExportError(f"cannot write {path}: {error.getMessage() or error}") from error


def convert_format(spark: SparkSession, source: str, target: str, format: str | None = None,
                   read_options: dict[str, Any] | None = None, **options: Any) -> None:
    """Rewrite a table in another format, the one asked for. ``read_options`` go
    to the reader, the others to the writer."""
    save_data(load_data(spark, source, **(read_options or {})), target, format=format, **options)


def processed_name(path: str) -> str:
    """Where a quick export of ``path`` goes."""
    p = PurePosixPath(str(path).rstrip("/"))
    return str(p.with_name(f"{p.stem}_processed.csv"))


def quick_export(df: DataFrame, source_path: str) -> str:
    target = processed_name(source_path)
    save_data(df, target, format="csv")
    return target


def with_chunk_ids(df: DataFrame, order_by: list[str], chunk_size: int | None = None) -> DataFrame:
    """Number the rows along ``order_by`` and cut them into fixed-size chunks."""
    size = chunk_size or get_config().chunk_size
    numbered = row_numbers(df, order_by, "__row")
    return numbered.withColumn("chunk_id", F.floor((F.col("__row") - 1) / F.lit(size)).cast("long")).drop("__row")


class FastDataLoader:
    """Loader bound to a session."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def load(self, path: str, **options: Any) -> DataFrame:
        return load_data(self.spark, path, **options)

    def scan_lazy(self, path: str, **options: Any) -> DataFrame:
        return load_data(self.spark, path, **options)

    def peek(self, path: str, n_rows: int | None = None, **options: Any) -> DataFrame:
        return peek(self.spark, path, n_rows, **options)

    def get_info(self, path: str, exact: bool = True) -> dict[str, Any]:
        facts = table_info(self.spark, path, exact=exact).first().asDict()
        return {**facts, "size_human": format_bytes(facts["size_bytes"] or 0), "columns": facts["columns"].split(",")}

    def stream_chunks(self, path: str, order_by: list[str] | None = None, chunk_size: int | None = None, **options: Any):
        """Tables of one chunk each, in order. Without ``order_by`` a Parquet table
        is cut in the order of its files: a chunk reads the row groups it touches
        and the table is not rewritten. Otherwise chunk ids are written once, so a
        chunk is a partition read rather than a pass over the whole table."""
        size = chunk_size or get_config().chunk_size
        df = load_data(self.spark, path, **options)
        if order_by is None:
            fmt = options.get("format") or detect_format(path)
            if fmt != "parquet" or not footers.can_open(self.spark, path):
                raise UnsupportedOperationError("chunks of this table need order_by: only Parquet files that tasks can open have an order")
            groups = materialize(footers.numbered_groups(self.spark, path), "row-groups")
            for chunk in footers.chunk_tables(groups, df.schema, size):
                yield chunk.drop(footers.CHUNK)
            return
        folder = work_folder(self.spark, "chunks")
        with_chunk_ids(df, order_by, size).write.partitionBy("chunk_id").parquet(folder)
        stored = self.spark.read.parquet(folder)
        last = stored.agg(F.max("chunk_id")).first()[0]
        for chunk in range(0 if last is None else last + 1):
            yield stored.where(F.col("chunk_id") == chunk).drop("chunk_id")


class DataSaver:
    def save(self, df: DataFrame, path: str, **options: Any) -> None:
        save_data(df, path, **options)
