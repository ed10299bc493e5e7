"""Order-dependent work over a whole table without one giant window.

Rows are cut into ranges of the whole order key. A window runs inside each range,
a summary with one row per (group, range) carries state across ranges, and a join
brings the carry back.  A group that holds a third of the table is spread over
many ranges instead of landing in one task, and so is a first key column that
many rows share.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparktidy.errors import DataValidationError
from sparktidy.functions.exprs import col
from sparktidy.plans.quantiles import as_splits, cut_values
from sparktidy.session import materialize

# The number of ranges follows the table, so a range stays one task's work. The
# upper limit holds for cuts of a numeric axis only, where oversized cells are divided.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 500_000, 16, 8192
FEW_ROWS = 4096
RANGE, GROUP = "__range", "__group"


def _key(df: DataFrame, name: str) -> Column:
    """A double that never decreases as the order key grows."""
    dtype, c = df.schema[name].dataType, col(name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    raise DataValidationError(f"cannot order by {name}: {dtype.simpleString()}")


def range_cuts(df: DataFrame, columns: list[str], ranges: int = 0) -> dict[str, list[float]]:
    """Cut points of several order keys, from one sketch pass. A value that
    repeats from cut to cut gets a second cut just above it, and so a range of
    its own. More ranges than the rows call for may be asked for, FEW_ROWS each."""
    rows, found = cut_values(df, {f"c{i}": _key(df, c) for i, c in enumerate(columns)}, MAX_RANGES)
    step = MAX_RANGES // min(max(rows // RANGE_ROWS, min(ranges, rows // FEW_ROWS), MIN_RANGES), MAX_RANGES)
    out = {}
    for i, c in enumerate(columns):
        cuts = found[f"c{i}"][step - 1::step]
        out[c] = cuts + [math.nextafter(a, math.inf) for a, b in zip(cuts, cuts[1:]) if a == b]
    return out


def with_ranges(df: DataFrame, order_by: str, cuts: list[float] | None = None) -> DataFrame:
    """Add the range number of every row. The cut points only balance the work
    and never change a result."""
    splits = as_splits(range_cuts(df, [order_by])[order_by] if cuts is None else cuts)
    keyed = df.withColumn("__key", F.coalesce(_key(df, order_by), F.lit(-math.inf)))
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol=RANGE, handleInvalid="keep").transform(keyed)
    return cut.withColumn(RANGE, F.col(RANGE).cast("int")).drop("__key")


def ordered_ranges(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add the range number of every row along the complete key list, texts in
    full. Spark samples the cut points; the table is written once so that every
    later read sees the same ranges. Their number follows the rows, without an
    upper limit."""
    ranges = max(MIN_RANGES, -(-df.count() // RANGE_ROWS))
    placed = df.repartitionByRange(ranges, *[col(c).asc_nulls_first() for c in order_by])
    return materialize(placed.withColumn(RANGE, F.spark_partition_id()), "ranges")


def _carry_back(local: DataFrame, carry: DataFrame, grouped: bool) -> DataFrame:
    """Join the per-range carry. Without groups it has one row per range."""
    if grouped:
        return local.join(carry, [GROUP, RANGE], "left")
    return local.join(F.broadcast(carry.drop(GROUP)), [RANGE], "left")


def _grouped(df: DataFrame, partition_by: list[str]) -> DataFrame:
    key = F.struct(*[col(c) for c in partition_by]) if partition_by else F.lit(0)
    return df.withColumn(GROUP, key)


def fill_along(
    df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] = (), forward: bool = True
) -> DataFrame:
    """Fill nulls with the nearest earlier (or later) non-null value."""
    if not order_by:
        raise DataValidationError("forward and backward fill need order_by")
    names = df.columns
    work = _grouped(ordered_ranges(df, order_by), list(partition_by))
    order = [col(c).asc() if forward else col(c).desc() for c in order_by]
    range_order = F.col(RANGE).asc() if forward else F.col(RANGE).desc()
    rank = F.struct(*[col(c) for c in order_by])
    newest = F.max_by if forward else F.min_by
    so_far = Window.partitionBy(GROUP, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(GROUP).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)

    summary = work.groupBy(GROUP, RANGE).agg(*[
        newest(col(c), F.when(col(c).isNotNull(), rank)).alias(f"__end{i}") for i, c in enumerate(columns)])
    carry = summary.select(GROUP, RANGE, *[
        F.last(f"__end{i}", True).over(earlier).alias(f"__carry{i}") for i in range(len(columns))])
    local = work.select("*", *[
        F.last(col(c), True).over(so_far).alias(f"__near{i}") for i, c in enumerate(columns)])
    filled = {c: F.coalesce(f"__near{i}", f"__carry{i}") for i, c in enumerate(columns)}
    joined = _carry_back(local, carry, bool(partition_by))
    return joined.select(*[filled[c].alias(c) if c in filled else col(c) for c in names])


def running_total(
    df: DataFrame, weight: Column, order_by: list[str], name: str, partition_by: list[str] = ()
) -> DataFrame:
    """Inclusive running sum of ``weight`` along the order key."""
    names = df.columns
    work = _grouped(ordered_ranges(df.withColumn("__w", weight), order_by), list(partition_by))
    so_far = (Window.partitionBy(GROUP, RANGE).orderBy(*[col(c) for c in order_by])
              .rowsBetween(Window.unboundedPreceding, 0))
    earlier = Window.partitionBy(GROUP).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    summary = work.groupBy(GROUP, RANGE).agg(F.sum("__w").alias("__sum"))
    carry = summary.select(GROUP, RANGE, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carry"))
    local = work.withColumn("__near", F.sum("__w").over(so_far))
    joined = _carry_back(local, carry, bool(partition_by))
    return joined.select(*[col(c) for c in names], (F.col("__near") + F.col("__carry")).alias(name))


def row_numbers(df: DataFrame, order_by: list[str], name: str = "row_number") -> DataFrame:
    """1-based position of every row along the order key."""
    return running_total(df, F.lit(1).cast("long"), order_by, name)
