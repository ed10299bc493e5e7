"""Missing values."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from sparktidy.config import get_config
from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col, null_share
from sparktidy.operators.knn import knn_impute
from sparktidy.plans.ordering import fill_along
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.sampling import BITS, key_bits
from sparktidy.plans.shape import rows_from

STRATEGIES = ("drop", "mean", "median", "mode", "ffill", "bfill", "custom", "distribution", "knn")


@dataclass(frozen=True)
class FillModel:
    """Constant fill values per column; works on batch and streaming tables."""

    values: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        fills = {c: F.coalesce(col(c), F.lit(v)) for c, v in self.values.items() if v is not None and c in df.columns}
        return df.withColumns(fills) if fills else df


def null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Row count and null count per column, in one aggregate."""
    row = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    return row["n"], {c: row["n"] - row[f"p{i}"] for i, c in enumerate(columns)}


def null_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing percentage per column."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(columns)])
    return rows_from(wide, [{"column": F.lit(c), "missing_pct": null_share(F.col("n"), F.col(f"p{i}"))}
                            for i, c in enumerate(columns)])


def _modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent non-null value, the smallest one on a tie. Counts are
    pre-aggregated; only the winner of each column reaches the driver."""
    tops = []
    for i, c in enumerate(columns):
        counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count("*").alias("n"))
        tops.append(counts.orderBy(F.desc("n"), F.asc("v")).limit(1)
                    .select(F.lit(i).alias("i"), F.struct("v").alias("s")))
    if len({df.schema[c].dataType for c in columns}) > 1:
        return {c: r["s"]["v"] for c, top in zip(columns, tops) for r in top.collect()}
    union = tops[0]
    for top in tops[1:]:
        union = union.unionByName(top)
    return {columns[r["i"]]: r["s"]["v"] for r in union.collect()}


def fit_fill(
    df: DataFrame, strategy: str, columns: list[str], custom_value: Any = None, accuracy: int | None = None
) -> FillModel:
    """Fit mean, median, mode or custom fill values. Columns without nulls are
    left alone, so their type does not widen."""
    _, nulls = null_counts(df, columns)
    open_columns = [c for c in columns if nulls[c]]
    if strategy in ("mean", "median"):
        numeric = set(kinds.numeric_columns(df))
        open_columns = [c for c in open_columns if c in numeric]
    if not open_columns:
        return FillModel()
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c).cast("double")) for c in open_columns]).first()
        return FillModel(dict(zip(open_columns, row)))
    if strategy == "median":
        cuts = quantiles(df, open_columns, [0.5], accuracy)
        return FillModel({c: cuts[c][0] for c in open_columns})
    if strategy == "mode":
        return FillModel(_modes(df, open_columns))
    if strategy == "custom":
        return FillModel({c: custom_value for c in open_columns})
    raise UnsupportedOperationError(f"no fill value for strategy {strategy}")


def draw_normal(df: DataFrame, columns: list[str], key: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Fill nulls with draws from N(mean, std) of the column. The draw is a
    Box-Muller transform of two hashes of the row key, so the same row always
    gets the same value however the table is partitioned or retried."""
    seed = get_config().random_state if seed is None else seed
    numeric = set(kinds.numeric_columns(df))
    columns = [c for c in columns if c in numeric]
    if not columns:
        return df
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count_if(col(c).isNull()).alias(f"z{i}"), F.avg(col(c).cast("double")).alias(f"m{i}"),
        F.stddev_samp(col(c).cast("double")).alias(f"s{i}"))]).first()
    fills = {}
    keys = [col(k) for k in key or df.columns]
    for i, c in enumerate(columns):
        if not row[f"z{i}"] or row[f"m{i}"] is None:
            continue

        def uniform(part: int):
            return (key_bits(keys, c, seed, part) + 0.5) / float(2**BITS)

        normal = F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * math.pi * uniform(2))
        fills[c] = F.coalesce(col(c).cast("double"), F.lit(row[f"m{i}"]) + F.lit(row[f"s{i}"] or 0.0) * normal)
    return df.withColumns(fills) if fills else df


def columns_within_threshold(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """Columns whose missing percentage does not exceed the threshold."""
    n, nulls = null_counts(df, columns)
    return [c for c in columns if n == 0 or nulls[c] * 100.0 / n <= threshold]


def impute(
    df: DataFrame, strategy: str = "median", columns: list[str] | None = None, custom_value: Any = None,
    drop_threshold: float | None = None, on_exceed: str = "skip", order_by: list[str] | None = None,
    partition_by: list[str] | None = None, key: list[str] | None = None, seed: int | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """Handle missing values. Columns above ``drop_threshold`` percent missing
    are skipped, or dropped with ``on_exceed="drop"``."""
    strategy = strategy.lower()
    if strategy not in STRATEGIES:
        raise UnsupportedOperationError(f"unknown imputation strategy: {strategy}")
    columns = [c for c in (columns or df.columns) if c in df.columns]
    if drop_threshold is not None:
        within = columns_within_threshold(df, columns, drop_threshold)
        if on_exceed == "drop":
            df = df.drop(*[c for c in columns if c not in within])
        columns = within
    if not columns:
        return df
    if strategy == "drop":
        return df.na.drop(subset=columns)
    if strategy in ("ffill", "bfill"):
        return fill_along(df, columns, list(order_by or []), list(partition_by or []), forward=strategy == "ffill")
    if strategy == "distribution":
        return draw_normal(df, columns, key, seed)
    if strategy == "knn":
        _, nulls = null_counts(df, columns)
        numeric = kinds.numeric_columns(df)
        for c in columns:
            if nulls[c] and c in numeric:
                if len(numeric) < 2:
                    df = fit_fill(df, "median", [c], accuracy=accuracy).transform(df)
                else:
                    df = knn_impute(df, c, key or order_by or [])
        return df
    return fit_fill(df, strategy, columns, custom_value, accuracy).transform(df)
