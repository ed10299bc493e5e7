"""Derived features: products, mathematical transforms and bins."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import MATH_TRANSFORMS, col, math_transform
from sparktidy.plans.clusters import cluster_means
from sparktidy.plans.quantiles import quantiles

BIN_STRATEGIES = ("quantile", "uniform", "kmeans")


@dataclass
class ProductModel:
    """Monomials to append, each a list of column names."""

    terms: list[list[str]] = field(default_factory=list)
    kind = "polynomial"

    def transform(self, df: DataFrame) -> DataFrame:
        new = [_product(t).alias(_term_name(t)) for t in self.terms if _term_name(t) not in df.columns]
        return df.select("*", *new) if new else df

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "terms": self.terms}

    @classmethod
    def from_dict(cls, d):
        return cls(d["terms"])


def _term_name(term: list[str]) -> str:
    powers = Counter(term)
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items()) or "1"


def _product(term: list[str]) -> Column:
    return reduce(Column.__mul__, [col(c).cast("double") for c in term], F.lit(1.0))


def fit_products(
    df: DataFrame, columns: list[str] | None = None, degree: int = 2, interaction_only: bool = False,
    include_bias: bool = False,
) -> ProductModel:
    """All products up to ``degree``; one column alone is left unchanged unless
    only interactions are wanted."""
    columns = list(columns or kinds.numeric_columns(df))
    if len(columns) < 2 and not interaction_only:
        return ProductModel()
    choose = combinations if interaction_only else combinations_with_replacement
    terms = [list(t) for d in range(2, degree + 1) for t in choose(columns, d)]
    return ProductModel(([[]] if include_bias else []) + terms)


def polynomial_features(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    return fit_products(df, columns, **options).transform(df)


@dataclass
class MathModel:
    transforms: dict[str, str] = field(default_factory=dict)
    create_new_columns: bool = True
    kind = "math_transform"

    def transform(self, df: DataFrame) -> DataFrame:
        changes = {}
        for c, name in self.transforms.items():
            if c in df.columns and name in MATH_TRANSFORMS:
                changes[f"{c}_{name}" if self.create_new_columns else c] = math_transform(col(c), name)
        return df.withColumns(changes) if changes else df

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "transforms": self.transforms, "create_new_columns": self.create_new_columns}

    @classmethod
    def from_dict(cls, d):
        return cls(d["transforms"], d["create_new_columns"])


def math_transforms(df: DataFrame, transforms: dict[str, str], create_new_columns: bool = True) -> DataFrame:
    """Apply a named function per column; results that are not finite are null."""
    return MathModel(dict(transforms), create_new_columns).transform(df)


@dataclass
class BinModel:
    """Edges per column. Bins are right-closed, the first includes its left edge;
    values beyond the fitted range fall into the outer bins."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    labels: list[str] | None = None
    kind = "binning"

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, edges in self.edges.items():
            v = col(c).cast("double")
            steps = [(v > F.lit(e)).cast("int") for e in edges[1:-1]]
            index = F.when(v.isNotNull(), reduce(Column.__add__, steps, F.lit(0)))
            if self.labels:
                index = F.try_element_at(F.array(*map(F.lit, self.labels)), index + 1)
            new[f"{c}_binned"] = index
        return df.withColumns(new) if new else df

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "edges": self.edges, "labels": self.labels}

    @classmethod
    def from_dict(cls, d):
        return cls(d["edges"], d["labels"])


def fit_bins(
    df: DataFrame, columns: list[str] | None = None, n_bins: int = 5, strategy: str = "quantile",
    labels: list[str] | None = None, accuracy: int | None = None,
) -> BinModel:
    if strategy not in BIN_STRATEGIES:
        raise UnsupportedOperationError(f"unknown binning strategy: {strategy}")
    columns = [c for c in (columns or kinds.numeric_columns(df)) if c in df.columns]
    edges: dict[str, list[float]] = {}
    if strategy == "quantile":
        cuts = quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)], accuracy)
        edges = {c: sorted(set(q)) for c, q in cuts.items() if q[0] is not None}
    else:
        row = df.agg(*[e for c in columns for e in (F.min(col(c).cast("double")), F.max(col(c).cast("double")))]).first()
        spans = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns) if row[2 * i] is not None}
        for c, (lo, hi) in spans.items():
            if strategy == "uniform":
                edges[c] = [lo + i * (hi - lo) / n_bins for i in range(n_bins + 1)]
            else:
                centres = cluster_means(df.select(col(c).cast("double").alias("v")), n_bins)
                edges[c] = [lo, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], hi]
    return BinModel(edges, list(labels) if labels else None)


def binned_features(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    return fit_bins(df, columns, **options).transform(df)
