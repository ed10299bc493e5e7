"""Univariate feature scores and selection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.operators.mutual import neighbour_information
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.shape import rows_from

METHODS = ("mutual_info", "chi2", "f_classif")
MI_ESTIMATORS = ("bins", "neighbours")
MI_BINS = 10
# Fewer distinct numeric targets than this count as classes.
CLASS_LIMIT = 20


def _complete(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    return df.select(col(target).alias("__t"), *[col(f).cast("double").alias(f) for f in features]).na.drop()


def anova_f(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Between-class over within-class variance per feature. Rows reduce to one
    aggregate per class before anything is compared."""
    data = _complete(df, target, features)
    mean = data.agg(*[F.avg(col(f)) for f in features]).first()
    classes = data.groupBy("__t").agg(F.count("*").alias("n"), *[e for i, f in enumerate(features) for e in (
        F.avg(col(f)).alias(f"m{i}"), F.var_pop(col(f)).alias(f"v{i}"))])
    n = F.col("n")
    wide = classes.agg(F.sum(n).alias("n"), F.count("*").alias("k"), *[e for i in range(len(features)) for e in (
        F.sum(n * F.pow(F.col(f"m{i}") - F.lit(mean[i]), 2)).alias(f"b{i}"), F.sum(n * F.col(f"v{i}")).alias(f"w{i}"))])
    between, within = F.col("k") - 1, F.col("n") - F.col("k")
    return rows_from(wide, [{
        "feature": F.lit(f),
        "score": F.try_divide(F.try_divide(F.col(f"b{i}"), between), F.try_divide(F.col(f"w{i}"), within)),
    } for i, f in enumerate(features)])


def chi2(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Chi-square of per-class sums of absolute values against class shares."""
    data = _complete(df, target, features)
    totals = data.agg(F.count("*"), *[F.sum(F.abs(col(f))) for f in features]).first()
    classes = data.groupBy("__t").agg(F.count("*").alias("n"), *[
        F.sum(F.abs(col(f))).alias(f"o{i}") for i, f in enumerate(features)])

    def share(i: int) -> Column:
        expected = F.col("n") / F.lit(float(totals[0])) * F.lit(totals[i + 1])
        return F.sum(F.try_divide(F.pow(F.col(f"o{i}") - expected, 2), expected))

    wide = classes.agg(*[share(i).alias(f"s{i}") for i in range(len(features))])
    return rows_from(wide, [{"feature": F.lit(f), "score": F.col(f"s{i}")} for i, f in enumerate(features)])


def _bin_index(v: Column, edges: list[float]) -> Column:
    return reduce(Column.__add__, [(v > F.lit(e)).cast("int") for e in sorted(set(edges))[1:-1]], F.lit(0))


def mutual_information(
    df: DataFrame, target: str, features: list[str], bins: int = MI_BINS, accuracy: int | None = None,
    estimator: str = "bins",
) -> DataFrame:
    """Plug-in mutual information (nats) of quantile bins and the target. A
    numeric target with many values is binned the same way, or, with the estimator
    ``neighbours``, compared by distances to nearest neighbours."""
    if estimator not in MI_ESTIMATORS:
        raise UnsupportedOperationError(f"unknown estimator: {estimator}")
    if estimator == "neighbours":
        if kinds.kind_of(df.schema[target].dataType) != kinds.NUMERIC:
            raise UnsupportedOperationError("neighbours need a numeric target")
        return neighbour_information(df, target, features)
    data = _complete(df, target, features)
    probs = [i / bins for i in range(bins + 1)]
    cuts = quantiles(data, features, probs, accuracy)
    label = F.col("__t").cast("string")
    if kinds.kind_of(df.schema[target].dataType) == kinds.NUMERIC:
        few = data.select("__t").distinct().limit(CLASS_LIMIT).count()
        if few >= CLASS_LIMIT:
            edges = quantiles(data, ["__t"], probs, accuracy)["__t"]
            label = _bin_index(F.col("__t").cast("double"), edges).cast("string")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), _bin_index(col(f), cuts[f]).alias("bin")) for f in features])
    joint = (data.select(label.alias("t"), F.inline(cells))
             .groupBy("feature", "bin", "t").agg(F.count("*").alias("n")))

    def entropy_sum(name: str, *by: str) -> DataFrame:
        """Sum of n ln n over the cells of a margin."""
        margin = joint if not by else joint.groupBy("feature", *by).agg(F.sum("n").alias("n"))
        return margin.groupBy("feature").agg(
            F.sum(F.col("n") * F.ln("n")).alias("s"), F.sum("n").alias("total")).withColumn("part", F.lit(name))

    parts = entropy_sum("xy").unionByName(entropy_sum("x", "bin")).unionByName(entropy_sum("y", "t"))
    pick = {p: F.max(F.when(F.col("part") == p, F.col("s"))) for p in ("xy", "x", "y")}
    n = F.max("total")
    return parts.groupBy("feature").agg(
        ((pick["xy"] - pick["x"] - pick["y"]) / n + F.ln(n)).alias("score"))


def feature_scores(df: DataFrame, target: str, method: str = "mutual_info", features: list[str] | None = None,
                   **options) -> DataFrame:
    """``feature, score`` for every numeric feature."""
    if target not in df.columns:
        raise DataValidationError(f"target column {target} not found")
    if method not in METHODS:
        raise UnsupportedOperationError(f"unknown selection method: {method}")
    features = features or [c for c in kinds.numeric_columns(df) if c != target]
    score = {"mutual_info": mutual_information, "chi2": chi2, "f_classif": anova_f}[method]
    return score(df, target, features, **options)


@dataclass
class SelectModel:
    keep: list[str]
    scores: dict[str, float] = field(default_factory=dict)
    kind = "select"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[col(c) for c in self.keep])

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "keep": self.keep, "scores": self.scores}

    @classmethod
    def from_dict(cls, d):
        return cls(d["keep"], d["scores"])


def fit_selection(df: DataFrame, target: str, method: str = "mutual_info", k: int = 10, **options) -> SelectModel:
    """The k best numeric features, the target and every non-numeric column."""
    if target not in df.columns:
        raise DataValidationError(f"target column {target} not found")
    features = [c for c in kinds.numeric_columns(df) if c != target]
    if not features:
        return SelectModel(df.columns)
    scores = {r["feature"]: r["score"] for r in feature_scores(df, target, method, features, **options).collect()}
    ranked = sorted(features, key=lambda f: (-(scores[f] if scores[f] is not None else -1.0), features.index(f)))
    best = set(ranked[:k])
    others = [c for c in df.columns if c not in features and c != target]
    return SelectModel([f for f in features if f in best] + [target] + others, scores)


def select_features(df: DataFrame, target: str, method: str = "mutual_info", k: int = 10, **options) -> DataFrame:
    return fit_selection(df, target, method, k, **options).transform(df)
