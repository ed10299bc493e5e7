"""WARC archives: written from a table, read back through a Python data source.

Writing uses Spark's text writer: a WARC record ends with two line ends, which is
the writer's line separator, so a record is one row, files are compressed and
committed as any other output, and a lost executor's files are written again.

Reading is the data source ``warc``. It plans partitions from the file list,
takes filters on record headers, parses each record's headers first, and reads
the block only of records that pass; a block that is not wanted is skipped and
never decoded. Files are opened through pyarrow's file systems, so the folder may
be in any store that Spark and pyarrow both know.

Defined cases: a null payload is empty; a null page id is written as an empty id
and read back as null, such a page refers to another page with its payload if
that has an id; rows that share the smallest id of a payload are all responses;
line ends and other control characters in an address are percent-encoded, a null
address has no header; an empty table gives an empty archive; further columns
are not read.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith)

from sparktidy.session import work_folder

RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed: RFC 4648
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed: WARC 1.1
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "date": "warc-date"}
SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", payload_bytes long, payload binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def base32(hexes: Column, digits: int = 40) -> Column:
    """Base32 of hexadecimal digits whose number divides by ten: forty bits make
    eight letters."""
    letters = []
    for at in range(0, digits, 10):
        bits = F.conv(F.substring(hexes, at + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1,
                                F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def sha1_base32(data: Column) -> Column:
    return base32(F.sha1(data.cast("binary")))


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html",
                 least_bytes: int = 0) -> DataFrame:
    """Which page is written whole and which refers to another.

    Only digests are grouped, and they combine before the shuffle. Payloads move
    once, to meet the digests that occur several times; a payload with a third of
    all pages is a skewed key of that join, which Spark may split."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("first"))).drop("first")


def record_text(date: str) -> Column:
    """One WARC record, without its end, from the columns of ``plan_records``."""
    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    uri = F.regexp_replace("url", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        uri = F.replace(uri, F.lit(char), F.lit(code))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to")))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archive(planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """Write compressed archives below ``path``, some records a file at most."""
    planned.select(record_text(date).alias("value")).write.option("lineSep", RECORD_END).option(
        "maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def parse(stream, wanted: Callable[[dict], bool], payload: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    """``(headers, payload length, payload)`` of the wanted records of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        left = int(headers["content-length"])
        if not wanted(headers):
            while left:
                skipped = len(stream.read(min(left, 1 << 20)))
                if not skipped:
                    raise ValueError("the archive ends inside a record")
                left -= skipped
            continue
        size, http = left, headers.get("content-type", "").startswith("application/http")
        if http:  # the block's own headers say how long the payload is
            size = None
            while left and (line := stream.readline(left)):
                left -= len(line)
                if not line.strip():
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    size = int(value)
            size = left if size is None else size
        body = None
        if payload and headers.get("warc-type") != "revisit":
            body = stream.read(left)
            if len(body) != left:
                raise ValueError("the archive ends inside a record")
        else:
            while left and (skipped := len(stream.read(min(left, 1 << 20)))):
                left -= skipped
        yield headers, size, body


class WarcReader(DataSourceReader):
    """Reads the archives below ``path``. Options: ``payload`` (true: the column
    is filled), ``partitionBytes`` (files are packed up to this many bytes)."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take what can be decided from the headers; hand back the rest."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", {v for v in f.value if v is not None}))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            elif name and isinstance(f, IsNull):
                self.tests.append((name, "none", None))
            else:
                yield f

    def wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            own = headers.get(name)
            if kind == "none":
                good = own is None
            else:
                good = own is not None and (kind == "some" or kind == "in" and own in value
                                            or kind == "starts" and own.startswith(value))
            if not good:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found
                       if f.is_file and f.base_name.endswith((".warc", ".warc.gz", ".txt", ".txt.gz"))
                       and not f.base_name.startswith((".", "_")))
        packs, room = [], 0
        for path, size in files:
            if not packs or size > room:
                packs.append([])
                room = self.most
            packs[-1].append(path)
            room -= size
        return [Files(pack) for pack in packs]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.paths:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, weight = [], 0
        for path in partition.paths:
            kind = "gzip" if path.endswith(".gz") else None
            with store.open_input_stream(path, compression=kind) as stream:
                for headers, size, body in parse(io.BufferedReader(stream, 1 << 18), self.wanted, self.payload):
                    rows.append((*(headers.get(h) for h in HEADERS.values()), size, body))
                    weight += len(body or b"") + 500
                    if weight > 4 << 20:
                        yield self.batch(rows)
                        rows, weight = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          [*HEADERS, "payload_bytes", "payload"])


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``. Spark hands filters to Python data sources only
    if its setting says so; it is set here where it is not."""
    if str(spark.conf.get(PUSHDOWN, "false")).lower() != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_of(urn: Column) -> Column:
    found = F.regexp_extract(urn, "urn:x-page:(-?[0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per page, read the archives back, and describe each record.

    Responses are described from the payload that was read; revisits from their
    headers, by a second read whose filter skips every payload."""
    spark = pages.sparkSession
    path = work_folder(spark, "warc")
    write_archive(plan_records(pages, least_bytes=least_bytes), path)
    whole = read_archive(spark, path).where("record_type = 'response'").select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    other = read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        page_of(F.col("refers_to")).alias("refers_to"))
    return whole.unionByName(other)
