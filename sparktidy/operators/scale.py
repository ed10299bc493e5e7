"""Feature scaling. Parameters come from one fit; applying them is a projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.functions.normal import inverse_normal
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.shape import rows_from

METHODS = ("standard", "minmax", "robust", "maxabs", "quantile_uniform", "quantile_normal")
MAX_KNOTS = 1000
NORMAL_CLIP = 1e-7


@dataclass
class ScaleModel:
    """``params[c] = (center, scale, span, offset)``: (x - center) / scale * span
    + offset; quantile methods keep their knots instead."""

    method: str
    params: dict[str, list[float]] = field(default_factory=dict)
    knots: dict[str, list[float]] = field(default_factory=dict)
    kind = "scale"

    def transform(self, df: DataFrame) -> DataFrame:
        changes = {}
        for c, (center, scale, span, offset) in self.params.items():
            e = (col(c).cast("double") - F.lit(center)) / F.lit(scale)
            if (span, offset) != (1.0, 0.0):
                e = e * F.lit(span) + F.lit(offset)
            changes[c] = e
        for c, knots in self.knots.items():
            changes[c] = _quantile_udf(knots, self.method == "quantile_normal")(col(c).cast("double"))
        return df.withColumns(changes) if changes else df

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "method": self.method, "params": self.params, "knots": self.knots}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "ScaleModel":
        return cls(d["method"], d["params"], d["knots"])


def _quantile_udf(knots: list[float], normal: bool):
    """Piecewise-linear rank over the knots; a value that repeats over several
    knots gets the middle of their ranks."""
    q = np.asarray(knots)
    p = np.linspace(0.0, 1.0, len(q))

    @F.pandas_udf("double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            v = x.to_numpy("float64", na_value=np.nan)
            rank = 0.5 * (np.interp(v, q, p) - np.interp(-v, -q[::-1], -p[::-1]))
            rank = np.where(v <= q[0], 0.0, np.where(v >= q[-1], 1.0, rank))
            if normal:
                rank = inverse_normal(np.clip(rank, NORMAL_CLIP, 1 - NORMAL_CLIP))
            yield pd.Series(rank).where(x.notna().to_numpy(), None)

    return place


def fit_scaler(
    df: DataFrame, method: str = "standard", columns: list[str] | None = None,
    feature_range: tuple[float, float] = (0.0, 1.0), accuracy: int | None = None,
) -> ScaleModel:
    method = method.lower()
    if method not in METHODS:
        raise UnsupportedOperationError(f"unknown scaling method: {method}")
    columns = list(columns or kinds.numeric_columns(df))
    model = ScaleModel(method)
    if not columns:
        return model
    if method.startswith("quantile"):
        n = df.count()
        k = max(2, min(MAX_KNOTS, n))
        cuts = quantiles(df, columns, [i / (k - 1) for i in range(k)], accuracy)
        model.knots = {c: list(np.maximum.accumulate(cuts[c])) for c in columns if cuts[c][0] is not None}
        return model
    if method == "robust":
        cuts = quantiles(df, columns, [0.25, 0.5, 0.75], accuracy)
        for c, (q1, median, q3) in cuts.items():
            if median is not None:
                model.params[c] = [median, (q3 - q1) or 1.0, 1.0, 0.0]
        return model
    wanted = {
        "standard": lambda v: (F.avg(v), F.stddev_pop(v)),
        "minmax": lambda v: (F.min(v), F.max(v)),
        "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
    }[method]
    row = df.agg(*[e.alias(f"{name}{i}") for i, c in enumerate(columns)
                   for name, e in zip("ab", wanted(col(c).cast("double")))]).first()
    low, high = feature_range
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if b is None:
            continue
        if method == "minmax":
            model.params[c] = [a, (b - a) or 1.0, float(high - low), float(low)]
        else:
            model.params[c] = [a, b or 1.0, 1.0, 0.0]
    return model


def scale(df: DataFrame, method: str = "standard", **options) -> DataFrame:
    return fit_scaler(df, method, **options).transform(df)


def scale_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample std per column on both sides."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        wide = df.agg(*[e for i, c in enumerate(columns) for e in (
            F.avg(col(c).cast("double")).alias(f"m{i}"), F.stddev_samp(col(c).cast("double")).alias(f"s{i}"))])
        return rows_from(wide, [{"column": F.lit(c), f"{tag}_mean": F.col(f"m{i}"), f"{tag}_std": F.col(f"s{i}")}
                                for i, c in enumerate(columns)])

    return side(before, "original").join(F.broadcast(side(after, "new")), "column")
