"""Outlier detection and treatment. Every method reduces to an interval of
accepted values per column, fitted once and applied as a plain expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.shape import rows_from
from sparktidy.session import materialize

METHODS = ("iqr", "zscore", "modified_zscore")
ACTIONS = ("remove", "cap", "transform")
# Cut-offs of the two score methods and the normal-consistency factor.
Z_LIMIT, MODIFIED_Z_LIMIT, MAD_FACTOR = 3.0, 3.5, 0.6745
CAP_LOW, CAP_HIGH = 0.05, 0.95


@dataclass(frozen=True)
class Fence:
    """Accepted interval of one column with the extremes seen while fitting."""

    column: str
    low: float | None
    high: float | None
    seen_min: float | None
    seen_max: float | None

    @property
    def crossed(self) -> bool:
        """Was any fitted value outside? Known from the extremes, without a count."""
        return self.low is not None and (self.seen_min < self.low or self.seen_max > self.high)

    def is_outlier(self) -> Column:
        if self.low is None:
            return F.when(col(self.column).isNotNull(), F.lit(False))
        v = col(self.column).cast("double")
        return (v < self.low) | (v > self.high)


def fit_fences(
    df: DataFrame, columns: list[str], method: str = "iqr", factor: float = 1.5, sample_std: bool = False,
    accuracy: int | None = None,
) -> dict[str, Fence]:
    """All columns are fitted together on the rows of ``df``."""
    if method == "iqr":
        cuts = quantiles(df, columns, [0.0, 0.25, 0.75, 1.0], accuracy)
        out = {}
        for c, (lo, q1, q3, hi) in cuts.items():
            reach = None if q1 is None else factor * (q3 - q1)
            out[c] = Fence(c, None, None, lo, hi) if reach is None else Fence(c, q1 - reach, q3 + reach, lo, hi)
        return out
    if method == "zscore":
        spread = F.stddev_samp if sample_std else F.stddev_pop
        row = df.agg(*[fn(col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate(columns)
                       for name, fn in (("m", F.avg), ("s", spread), ("lo", F.min), ("hi", F.max))]).first()
        out = {}
        for i, c in enumerate(columns):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            reach = Z_LIMIT * std if std else None
            low, high = (None, None) if reach is None else (mean - reach, mean + reach)
            out[c] = Fence(c, low, high, row[f"lo{i}"], row[f"hi{i}"])
        return out
    if method == "modified_zscore":
        first = quantiles(df, columns, [0.0, 0.5, 1.0], accuracy)
        known = [c for c in columns if first[c][1] is not None]
        away = df.select(*[F.abs(col(c).cast("double") - F.lit(first[c][1])).alias(c) for c in known])
        second = quantiles(away, known, [0.5], accuracy)
        out = {}
        for c in columns:
            lo, median, hi = first[c]
            mad = second[c][0] if c in second else None
            reach = MODIFIED_Z_LIMIT * mad / MAD_FACTOR if mad else None
            low, high = (None, None) if reach is None else (median - reach, median + reach)
            out[c] = Fence(c, low, high, lo, hi)
        return out
    raise UnsupportedOperationError(f"unknown outlier method: {method}")


def _numeric(df: DataFrame, columns: list[str] | None) -> list[str]:
    if columns is None:
        return kinds.numeric_columns(df)
    return [c for c in columns if c in df.columns]


def outlier_report(
    df: DataFrame, columns: list[str] | None = None, method: str = "iqr", accuracy: int | None = None
) -> DataFrame:
    """Outlier count and share of the non-null values per column."""
    columns = _numeric(df, columns)
    fences = fit_fences(df, columns, method, accuracy=accuracy)
    wide = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(col(c)).alias(f"n{i}"), F.count_if(fences[c].is_outlier()).alias(f"o{i}"))])
    return rows_from(wide, [{
        "column": F.lit(c), "method": F.lit(method), "total_count": F.col(f"n{i}"), "outlier_count": F.col(f"o{i}"),
        "outlier_pct": F.try_divide(F.col(f"o{i}") * 100.0, F.col(f"n{i}")),
        "lower": F.lit(fences[c].low).cast("double"), "upper": F.lit(fences[c].high).cast("double"),
    } for i, c in enumerate(columns)])


def outlier_rows(
    df: DataFrame, key: list[str], columns: list[str] | None = None, method: str = "iqr",
    accuracy: int | None = None,
) -> DataFrame:
    """Key, column and value of every outlier; no shuffle after the fit."""
    columns = _numeric(df, columns)
    fences = fit_fences(df, columns, method, accuracy=accuracy)
    cells = F.array(*[
        F.when(fences[c].is_outlier(), F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")))
        for c in columns])
    return df.select(*[col(k) for k in key], F.inline(F.filter(cells, lambda s: s.isNotNull())))


def treat_outliers(
    df: DataFrame, method: str = "iqr", action: str = "remove", columns: list[str] | None = None,
    factor: float = 1.5, fit: str = "sequential", keep_nulls: bool = False, accuracy: int | None = None,
    stage: bool = False,
) -> DataFrame:
    """Remove, cap or log-transform outliers.

    ``fit="sequential"`` refits each column on the rows earlier columns left
    (one small job per column); ``fit="joint"`` fits all columns at once.
    ``stage`` writes the columns to fit once to a table, for inputs that are
    costly to compute, such as the result of a shuffle.
    """
    if method not in METHODS:
        raise UnsupportedOperationError(f"unknown outlier method: {method}")
    if action not in ACTIONS:
        raise UnsupportedOperationError(f"unknown outlier action: {action}")
    columns = _numeric(df, columns)
    fitted = materialize(df.select(*[col(c) for c in columns]), "outliers") if stage and columns else df
    # Only removal changes the rows later columns are fitted on.
    if action != "remove" or fit == "joint":
        fences = fit_fences(fitted, columns, method, factor, sample_std=True, accuracy=accuracy)
        hit = [c for c in columns if fences[c].crossed]
        if action == "remove":
            for c in hit:
                df = _without(df, fences[c], keep_nulls)
            return df
        if action == "cap":
            caps = quantiles(fitted, hit, [CAP_LOW, CAP_HIGH], accuracy)
            return df.withColumns({c: _clamped(c, *caps[c]) for c in hit})
        return df.withColumns({c: F.ln(col(c).cast("double")) for c in hit if fences[c].seen_min > 0})
    for c in columns:
        fence = fit_fences(fitted, [c], method, factor, sample_std=True, accuracy=accuracy)[c]
        if fence.crossed:
            df, fitted = _without(df, fence, keep_nulls), _without(fitted, fence, keep_nulls)
    return df


def _without(df: DataFrame, fence: Fence, keep_nulls: bool) -> DataFrame:
    keep = ~fence.is_outlier()
    return df.where(F.coalesce(keep, F.lit(True)) if keep_nulls else keep)


def _clamped(c: str, low: float, high: float) -> Column:
    v = col(c).cast("double")
    return F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
