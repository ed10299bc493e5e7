"""Spark SQL over prepared tables, and two joins SQL text leaves slow or lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.errors import DataValidationError
from sparktidy.functions.exprs import col
from sparktidy.plans.ordering import RANGE, fill_along, range_cuts, with_ranges
from sparktidy.session import materialize


def sql(tables: DataFrame | dict[str, DataFrame], query: str) -> DataFrame:
    """Run Spark SQL. A single table is called ``data``. The plan is resolved
    on return, so the views may be replaced afterwards."""
    named = {"data": tables} if isinstance(tables, DataFrame) else tables
    if not named:
        raise DataValidationError("no tables to query")
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return next(iter(named.values())).sparkSession.sql(query)


def to_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON record, in a column ``record``."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("record"))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], right_columns: list[str]) -> DataFrame:
    """For each left row the latest right row of the same group at or before it.
    Both sides share one ordered pass that carries the right values forward, so
    a group holding much of the table is spread over ranges of the order key.
    As in SQL, null keys match nothing: such right rows are left out, such left
    rows have nulls on the right."""
    all_left, right = left, right.na.drop(subset=[on, *by])
    left = all_left.na.drop(subset=[on, *by])
    lost = F.lit(False)
    for k in (on, *by):
        lost = lost | col(k).isNull()
    unmatched = all_left.where(lost).select(
        *[col(c) for c in all_left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right_columns])
    carried = F.struct(*[col(c) for c in right_columns])
    names = [c for c in left.columns if c not in (on, *by)]
    keys = [*by, on]
    a = left.select(*[col(k) for k in keys], F.struct(*[col(c) for c in names]).alias("__left"),
                    F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("__right"),
                    F.lit(1).alias("__side"))
    b = right.select(*[col(k) for k in keys], F.lit(None).cast(a.schema["__left"].dataType).alias("__left"),
                     carried.alias("__right"), F.lit(0).alias("__side"))
    filled = fill_along(a.unionByName(b), ["__right"], [on, "__side"], by)
    return filled.where(F.col("__side") == 1).select(
        *[F.col(f"__left.`{c}`").alias(c) if c in names else col(c) for c in left.columns],
        *[F.col(f"__right.`{c}`").alias(c) for c in right_columns]).unionByName(unmatched)


FAN_BITS = 4  # sixteen cells make a cell of the next level
# Intervals that pay for a further cell; points and intervals that meet in a tile; pairs
# that a task compares and rows that it reads; most tasks, which then take more pairs.
CELL_RANGES, RANGE_ROWS, BLOCK_ROWS, TASK_PAIRS, TASK_ROWS, MAX_TASKS = 32, 16_384, 4096, 1 << 26, 500_000, 10_000


def _levels(cells: int) -> int:
    """Levels of cells until one level has no more than sixteen."""
    levels = 1
    while cells > 1 << (FAN_BITS * levels):
        levels += 1
    return levels


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The cells of all levels that make up the run ``first`` to ``last``, each once:
    up to fifteen at either end of every level, whatever the length of the run."""
    fan, nothing, out = 1 << FAN_BITS, F.array().cast("array<struct<level:int,cell:int>>"), []
    for level in range(levels):
        def run(a: Column, b: Column, level=level) -> Column:
            return F.when(a <= b, F.transform(F.sequence(a, b), lambda c: F.struct(
                F.lit(level).alias("level"), c.cast("int").alias("cell")))).otherwise(nothing)

        if level == levels - 1:
            out.append(run(first, last))
            break
        above_first, above_last = F.ceil(first / fan).cast("int"), (F.floor((last + 1) / fan) - 1).cast("int")
        left_end = F.least(last, above_first * fan - 1)
        out.append(run(first, left_end))
        out.append(run(F.greatest(left_end + 1, (above_last + 1) * fan), last))
        first, last = above_first, above_last
    return F.concat(*out)


def _at(level: Column, cell: Column) -> Column:
    """A cell of a level as one number; there are fewer than 2^16 cells."""
    return (F.shiftleft(level, 16) + cell).cast("long")


def _part(df: DataFrame, parts: str) -> Column:
    """The part of its cell that a row belongs to. Maps and variants have no hash."""
    hashed = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.pmod(F.xxhash64(*[col(c) for c in hashed]), F.col(parts))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Inner join on ``low <= point < high`` as an equality join on cells of the
    point axis instead of comparing every pair.

    Cells hold about equally many points, and there are more of them the more intervals
    there are; sixteen make a cell of the next level. An interval goes to the few cells
    of all levels that make it up, so one that spans the axis costs as much as a short
    one, and a point to the cells above it that some interval uses. A cell is divided both ways into tiles: its points into
    pieces, its intervals into blocks, and every piece meets every block once. The
    number of tasks follows the pairs that meet, which few bytes may make many of. Null
    ends and points match nothing."""
    cuts = range_cuts(points, [point], ranges.count() // CELL_RANGES)[point]
    levels = _levels(len(cuts) + 1)
    r = with_ranges(ranges, low, cuts).withColumnRenamed(RANGE, "__first")
    r = with_ranges(r, high, cuts).withColumnRenamed(RANGE, "__last").where(col(low) < col(high))
    r = r.withColumn("__at", F.explode(_cover(F.col("__first"), F.col("__last"), levels))).drop("__first", "__last")
    r = r.withColumn("__at", _at(F.col("__at.level"), F.col("__at.cell")))
    p = with_ranges(points.where(col(point).isNotNull()), point, cuts)
    above = F.array(*[_at(F.lit(i), F.shiftright(RANGE, FAN_BITS * i)) for i in range(levels)])
    # no more cells than there are on the axis, however many points and intervals
    held = p.groupBy(RANGE).agg(F.count("*").alias("__n")).select(F.explode(above).alias("__at"), "__n")
    cells = held.groupBy("__at").agg(F.sum("__n").alias("__n")).join(r.groupBy("__at").agg(F.count("*").alias("__m")), "__at")
    cells = materialize(cells.withColumn("__pieces", F.ceil(F.col("__n") / F.lit(RANGE_ROWS))).withColumn(
        "__blocks", F.ceil(F.col("__m") / F.lit(BLOCK_ROWS))), "cells")
    pairs, rows = cells.agg(F.sum(F.expr("double(__n) * __m")), F.sum(F.expr("double(__n) * __blocks + __m * __pieces"))).first()
    tasks = min(math.ceil((pairs or 0) / TASK_PAIRS), MAX_TASKS)
    cells = F.broadcast(cells.select("__at", F.shiftleft("__at", 44).alias("__tile"), "__pieces", "__blocks"))
    blocks, last_block = F.col("__blocks"), F.col("__blocks") - 1
    first = F.col("__tile") + _part(points, "__pieces") * blocks
    p = p.withColumn("__at", F.explode(above)).drop(RANGE).join(cells, "__at").withColumn(
        "__tile", F.explode(F.sequence(first, first + last_block))).drop("__at", "__pieces", "__blocks")
    first = F.col("__tile") + _part(ranges, "__blocks")
    r = r.join(cells, "__at").withColumn("__tile", F.explode(F.sequence(
        first, first + (F.col("__pieces") - 1) * blocks, blocks))).drop("__at", "__pieces", "__blocks")
    if tasks > max((rows or 0) / TASK_ROWS, 1):  # a fixed number is not put back into fewer tasks because the bytes are few
        p, r = p.repartition(tasks, "__tile"), r.repartition(tasks, "__tile")
    return (p.join(r, "__tile")
            .where((col(point) >= col(low)) & (col(point) < col(high))).drop("__tile"))
