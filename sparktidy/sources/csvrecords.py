"""CSV whose cells hold line ends, read by many tasks a file.

Spark cuts a file into blocks of lines. A task cannot know whether its block begins
within quotes, so it follows both cases until they agree, which they do at nearly
every line with a quoted cell. What a block makes of either beginning is composed
along the file afterwards, one row a block, and tells which case holds. Records
that cross blocks are joined from their pieces.

Quotes open a cell only at its start; a quote is doubled within quotes; after the
closing quote a cell lasts to the next separator. Records end with ``\\n`` or
``\\r\\n``. Lines are scanned once and written as records, so that every later read
sees the same blocks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sparktidy.errors import DataLoadError
from sparktidy.session import materialize

SUMMARY, WHOLE, LEAD, TAIL = range(4)
OUTSIDE, INSIDE, EITHER = range(3)
#: Blocks (of 128 MB by Spark's default) that one record may cross; beyond, its quote counts as never closed.
MOST_BLOCKS = 8
SCANNED = "file long, block long, kind int, case int, head boolean, record string, after_outside boolean, after_inside boolean"
#: Reader options that leave the form of records alone.
OPTIONS = {"header", "sep", "encoding", "mode", "escape", "quote", "inferSchema", "samplingRatio", "nullValue", "emptyValue",
           "nanValue", "positiveInf", "negativeInf", "dateFormat", "timestampFormat", "timestampNTZFormat", "locale"}


def fits(spark: SparkSession, path: str, options: dict[str, Any]) -> bool:
    """Whether the options and the folder are of the plain kind read here."""
    quote = options.get("quote", '"')
    return (set(options) <= OPTIONS and len(quote) == 1 and options.get("escape", quote) == quote
            and str(options.get("encoding", "utf-8")).lower() in ("utf-8", "utf8")
            and str(options.get("mode", "PERMISSIVE")).upper() in ("PERMISSIVE", "FAILFAST")
            and spark.read.text(str(path)).columns == ["value"])


def ends_inside(line: str, inside: bool, quote: str, sep: str) -> bool:
    """Whether a line that begins within quotes (or not) ends within quotes."""
    at = 0
    if not inside:
        if not line.startswith(quote):
            at = line.find(sep + quote)
            if at < 0:
                return False
            at += len(sep)
        at += 1
    while True:
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):
            at += 2
            continue
        at = line.find(sep + quote, at + 1)
        if at < 0:
            return False
        at += len(sep) + 1


class _Block:
    """The records of one block, for both ways in which it may begin."""

    def __init__(self, file: int, block: int, quote: str, sep: str):
        self.file, self.block, self.quote, self.sep = file, block, quote, sep
        self.rows: list[tuple] = []
        self.inside = {OUTSIDE: False, INSIDE: True}
        self.open: dict[int, list[str]] = {OUTSIDE: [], INSIDE: []}
        self.lead, self.head = True, block == 0

    def _emit(self, kind: int, case: int, lines: list[str]) -> None:
        head = self.head and kind != LEAD and case != INSIDE
        self.rows.append((self.file, self.block, kind, case, head, "\n".join(lines), None, None))
        if head:
            self.head = False

    def add(self, line: str) -> None:
        quoted = self.quote in line
        for case in list(self.inside):
            was = self.inside[case]
            now = ends_inside(line, was, self.quote, self.sep) if quoted else was
            self.inside[case] = now
            if not now and not self.open[case] and not (case == INSIDE and self.lead):
                self._emit(WHOLE, case, [line])
                continue
            self.open[case].append(line)
            if not now:
                leading = case == INSIDE and self.lead
                self._emit(LEAD if leading else WHOLE, case, self.open[case])
                self.open[case] = []
                self.lead = self.lead and not leading
        if len(self.inside) == 2 and not any(self.inside.values()):
            self.inside, self.open = {EITHER: False}, {EITHER: []}

    def add_all(self, lines: list[str]) -> None:
        """The same for many lines: once both cases agree, cell by cell."""
        at = 0
        while len(self.inside) == 2 and at < len(lines):
            self.add(lines[at])
            at += 1
        if at < len(lines):
            self._add_text("\n".join(lines[at:]) + "\n")

    def _add_text(self, text: str) -> None:
        quote, opening = self.quote, self.sep + self.quote
        inside, going, start, at = self.inside[EITHER], self.open[EITHER], 0, 0
        while at < len(text):
            if not inside and at == start and text.startswith(quote, at):
                inside, at = True, at + 1
            while inside:
                at = text.find(quote, at)
                if at < 0:  # goes on after these lines
                    self.inside[EITHER], self.open[EITHER] = True, [*going, text[start:-1]]
                    return
                inside = text.startswith(quote, at + 1)
                at += 2 if inside else 1
            end = text.index("\n", at)
            cell = text.find(opening, at, end)
            if cell >= 0:
                inside, at = True, cell + len(opening)
                continue
            self._emit(WHOLE, EITHER, [*going, text[start:end]])
            going, start, at = [], end + 1, end + 1
        self.inside[EITHER], self.open[EITHER] = False, []

    def finish(self) -> None:
        for case, lines in self.open.items():
            if lines:
                self._emit(LEAD if case == INSIDE and self.lead else TAIL, case, lines)
        after = [self.inside.get(case, self.inside.get(EITHER)) for case in (OUTSIDE, INSIDE)]
        self.rows.append((self.file, self.block, SUMMARY, EITHER, False, None, *after))

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _scanner(quote: str, sep: str, columns: list[str]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: _Block | None = None
        for batch in batches:
            rows: list[tuple] = []
            files, starts, lines = batch["file"].to_numpy(), batch["block"].to_numpy(), batch["value"].tolist()
            turns = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            ends = [0, *turns.tolist(), len(lines)]
            for low, high in zip(ends, ends[1:]):
                if low == high:
                    continue
                file, start = int(files[low]), int(starts[low])
                if block is None or (block.file, block.block) != (file, start):
                    if block is not None:
                        block.finish()
                        rows += block.taken()
                    block = _Block(file, start, quote, sep)
                block.add_all(lines[low:high])
            rows += block.taken() if block is not None else []
            yield pd.DataFrame(rows, columns=columns)
        if block is not None:
            block.finish()
            yield pd.DataFrame(block.taken(), columns=columns)

    return scan


def _beginnings(scanned: DataFrame) -> DataFrame:
    """Per block the case that holds. A block either ends the same way whatever
    its beginning, or keeps the state, or turns it: the last one of the first
    kind decides, with the number of turns since."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = scanned.where(F.col("kind") == SUMMARY)
    fixed = F.when(F.col("after_outside") == F.col("after_inside"), F.col("after_outside").cast("int"))
    turns = (F.col("after_outside") & ~F.col("after_inside")).cast("int")
    blocks = blocks.select("file", "block", fixed.alias("fixed"), turns.alias("turn"))
    counted = blocks.withColumn("turns", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), True).over(before)
    held = counted.withColumn("last", last)
    since = F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    return held.select("file", "block", F.pmod(F.coalesce(F.col("last.fixed"), F.lit(0)) + since, F.lit(2)).cast("int").alias("begins"))


def records(spark: SparkSession, path: str, quote: str, sep: str) -> DataFrame:
    """One row per record: ``file``, ``head`` (the first of its file) and ``record``."""
    # Lines carry their file as a number: most are far shorter than a path.
    name = F.col("_metadata.file_path")
    lines = spark.read.option("lineSep", "\n").text(str(path)).select(
        "value", F.xxhash64(name).alias("file"), F.col("_metadata.file_block_start").alias("block"))
    paths = F.broadcast(spark.read.format("binaryFile").load(str(path)).select(F.xxhash64(name).alias("file"), name.alias("path")))
    columns = T.StructType.fromDDL(SCANNED).names
    scanned = materialize(lines.mapInPandas(_scanner(quote, sep, columns), SCANNED), "csv-records")
    # One row a block of the files, some ten bytes for every hundred million read.
    begins = F.broadcast(_beginnings(scanned))
    held = scanned.where(F.col("kind") != SUMMARY).join(begins, ["file", "block"]).where(
        F.col("case").isin(EITHER) | (F.col("case") == F.col("begins")))
    whole = held.where(F.col("kind") == WHOLE).select("file", "head", "record")
    pieces = held.where(F.col("kind") != WHOLE)
    so_far = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chains = pieces.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(so_far))
    longest = chains.groupBy("file", "chain").agg(F.count("*").alias("n")).where(F.col("n") > MOST_BLOCKS + 1).head(1)
    if longest:
        at = paths.where(F.col("file") == longest[0]["file"]).first()["path"]
        raise DataLoadError(f"a quote in {at} stays open over more than {MOST_BLOCKS} blocks")
    joined = chains.groupBy("file", "chain").agg(
        F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts")).select(
        "file", "head", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    text = F.regexp_replace("record", r"\r\z", "")
    found = whole.unionByName(joined).withColumn("record", text).where(F.trim("record") != "")
    return found.join(paths, "file").select(F.col("path").alias("file"), "head", "record")


def _names(head: str, options: dict[str, Any], quote: str, sep: str) -> list[str]:
    cells = next(csv.reader([head.lstrip("﻿")], delimiter=sep, quotechar=quote), [])
    if not options["header"]:
        return [f"_c{i}" for i in range(len(cells))]
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read(spark: SparkSession, path: str, schema: T.StructType | str | None, options: dict[str, Any]) -> DataFrame:
    """The table in a CSV file or folder; ``options`` are the reader's."""
    quote, sep = options.get("quote", '"'), options["sep"]
    header = str(options.get("header", False)).lower() == "true"
    found = records(spark, path, quote, sep)
    body = found.where(~F.col("head")) if header else found
    parsing = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()
               if k not in ("header", "inferSchema", "samplingRatio", "encoding")} | {"multiLine": "true"}
    if schema is None:
        first = found.where("head").orderBy("file").head(1)
        names = _names(first[0]["record"], {"header": header}, quote, sep) if first else []
        if not names:
            raise DataLoadError(f"cannot infer the columns of {path}: no records")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if str(options.get("inferSchema", False)).lower() == "true":
            given = spark.read.options(**parsing, inferSchema=True, samplingRatio=options.get("samplingRatio", 1.0))
            types = [f.dataType for f in given.csv(body.select("record").rdd.map(lambda r: r[0])).schema.fields]
            schema = T.StructType([T.StructField(n, types[i] if i < len(types) else T.StringType()) for i, n in enumerate(names)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return body.select(F.from_csv("record", schema.toDDL(), parsing).alias("row")).select("row.*")
