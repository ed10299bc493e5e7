"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.functions.exprs import col


def remove_duplicates(
    df: DataFrame, columns: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None
) -> DataFrame:
    """Keep the first, the last or none of the rows that agree on ``columns``.

    Whole-row duplicates are interchangeable, so first and last are the same
    hash aggregate. On a subset, first and last follow ``order_by``: the
    rank-one filter runs before the shuffle as well as after it, so a key that
    holds much of the table sends one row per task. Without ``order_by`` any row
    of the group may stay, as with ``dropDuplicates``.
    """
    if keep not in ("first", "last", "none"):
        raise UnsupportedOperationError(f"unknown keep: {keep}")
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise DataValidationError(f"unknown columns: {missing}")
    names = df.columns
    if keep == "none":
        keys = list(columns or names)
        rest = [c for c in names if c not in keys]
        groups = df.groupBy(*[col(k) for k in keys]).agg(
            F.count("*").alias("__copies"),
            *([F.any_value(F.struct(*[col(c) for c in rest])).alias("__rest")] if rest else []))
        return groups.where(F.col("__copies") == 1).select(
            *[F.col("__rest").getField(c).alias(c) if c in rest else col(c) for c in names])
    if columns is None or set(columns) == set(names):
        return df.dropDuplicates()
    if not order_by:
        return df.dropDuplicates(list(columns))
    order = [col(o).asc() if keep == "first" else col(o).desc() for o in order_by]
    position = F.row_number().over(Window.partitionBy(*[col(c) for c in columns]).orderBy(*order))
    return df.withColumn("__position", position).where(F.col("__position") == 1).drop("__position")
