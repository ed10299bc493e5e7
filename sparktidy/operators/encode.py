"""Categorical encoding: fit distinct values once, apply as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparktidy.config import get_config
from sparktidy.errors import DataValidationError, UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.plans.lookup import COLUMN, VALUE, cell, lookup, lookup_columns
from sparktidy.plans.ordering import row_numbers
from sparktidy.plans.shape import column_counts
from sparktidy.session import materialize

METHODS = ("label", "onehot", "ordinal", "target")
# Methods with a configured limit of values.
LIMITED = ("onehot", "label")
# Up to this many categories a map is part of the expression; beyond it the
# map stays a table and is joined. Results, errors and saving are the same.
INLINE_LIMIT = 1000


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column, null counted as one."""
    missing = F.when(F.col("present") < F.col("n"), 1).otherwise(0)
    return column_counts(df, columns).select("column", (F.col("distinct") + missing).alias("unique_count"))


def encode_eligibility(df: DataFrame, columns: list[str] | None = None, method: str = "label",
                       max_values: int | None = None) -> DataFrame:
    """Which columns may be encoded: more than one value, not above the limit
    (``max_values``, or the configured one of the method)."""
    columns = columns or kinds.categorical_columns(df)
    limits = dict(zip(LIMITED, (get_config().max_features_for_onehot, get_config().max_features_for_label)))
    if max_values is not None:
        limits[method] = max_values
    n = F.col("unique_count")
    over = n > F.lit(limits[method]) if method in limits else F.lit(False)
    reason = F.when(over, "too many values").when(n == 1, "single value").otherwise("")
    return unique_counts(df, columns).withColumn("reason", reason).withColumn("eligible", F.col("reason") == "")


def _single_values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Reasons of ``encode_eligibility`` where no number of values is the limit:
    bounds and nulls tell a single value, and no row is shuffled."""
    row = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(columns) for e in (
        F.count(col(c)).alias(f"p{i}"), (F.min(col(c)) == F.max(col(c))).alias(f"one{i}"))]).first()
    one = {c: row["n"] > 0 and (row[f"p{i}"] == 0 or row[f"p{i}"] == row["n"] and row[f"one{i}"]) for i, c in enumerate(columns)}
    return {c: "single value" if one[c] else "" for c in columns}


@dataclass
class EncodeModel:
    """Fitted encoder. ``classes`` holds the ordered values (or value -> target
    mean) of each column; ``tables`` holds maps too large for an expression,
    ``skipped`` the columns left alone with the reason."""

    method: str
    classes: dict[str, list[Any]] = field(default_factory=dict)
    means: dict[str, list[float]] = field(default_factory=dict)
    default: float | None = None
    drop_original: bool = True
    handle_unknown: str = "ignore"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    kind = "encode"

    def _code(self, c: str) -> Column:
        values = self.classes[c]
        position = F.nullif(F.array_position(F.array(*map(F.lit, values)), col(c)), F.lit(0)).cast("int")
        return self._known(c, position.isNotNull(), position)

    def _known(self, c: str, found: Column, value: Column) -> Column:
        """``value``; an unseen category is an error if the model says so."""
        if self.handle_unknown != "error":
            return value
        message = F.concat(F.lit(f"unknown category in {c}: "), col(c).cast("string"))
        return F.when(col(c).isNotNull() & ~found, F.raise_error(message).cast("int")).otherwise(value)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.tables:
            df = self._joined(df)
        out: list[Column] = []
        extra: list[Column] = []
        for name in df.columns:
            if name not in self.classes:
                out.append(col(name))
                continue
            values = self.classes[name]
            if self.method == "onehot":
                seen = col(name).isin(values)
                extra += [self._known(name, seen, (col(name) == F.lit(v)).cast("int")).cast("tinyint").alias(f"{name}_{v}")
                          for v in values]
                if not self.drop_original:
                    out.append(col(name))
                continue
            code = self._code(name)
            if self.method == "target":
                # An unseen category falls back to the overall mean.
                code = F.when(col(name).isNotNull(), F.coalesce(
                    F.try_element_at(F.array(*map(F.lit, self.means[name])), code), F.lit(self.default)))
            else:
                code = code - 1
            if self.drop_original:
                out.append(code.alias(name))
            else:
                out.append(col(name))
                extra.append(code.alias(f"{name}_encoded"))
        return df.select(*out, *extra)

    def _joined(self, df: DataFrame) -> DataFrame:
        """Codes of the columns whose maps are tables. All of them are looked up
        together; on a stream, where nothing can be written, one after the other."""
        columns, kept = list(self.tables), df.columns
        codes = [f"__code{i}" for i in range(len(columns))]
        if df.isStreaming:
            for c, code in zip(columns, codes):
                df = lookup(df, self.tables[c].select(col(c), "__n", F.col("__code").alias(code)), c, "__n")
        else:
            maps = [t.select(F.lit(i).alias(COLUMN), cell(t, c).alias(VALUE), "__code") for i, (c, t) in enumerate(self.tables.items())]
            df = lookup_columns(df, [cell(df, c) for c in columns], reduce(DataFrame.unionByName, maps), "__code", codes)
        found = {}
        for c, code in zip(columns, codes):
            value = F.col(code)
            if self.method == "target":
                value = F.when(col(c).isNotNull(), F.coalesce(value, F.lit(self.default)))
            else:
                value = self._known(c, value.isNotNull(), value)
            found[c] = value
        if not self.drop_original:
            return df.select(*[col(c) for c in kept], *[v.alias(f"{c}_encoded") for c, v in found.items()])
        return df.select(*[found[c].alias(c) if c in found else col(c) for c in kept])

    def to_dict(self, folder: str | None = None) -> dict[str, Any]:
        """Parameters for JSON. Maps that are tables are written below ``folder``,
        which has to be one that every executor reaches."""
        if self.tables and folder is None:
            raise UnsupportedOperationError(f"maps of {sorted(self.tables)} are tables; a folder is needed to store them")
        paths = {c: f"{folder}/{i}" for i, c in enumerate(self.tables)}
        for c, table in self.tables.items():
            table.write.mode("overwrite").parquet(paths[c])
        return {"kind": self.kind, "method": self.method, "classes": self.classes, "means": self.means,
                "default": self.default, "drop_original": self.drop_original, "handle_unknown": self.handle_unknown,
                "skipped": self.skipped, "tables": paths}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "EncodeModel":
        stored = d.get("tables") or {}
        model = cls(**{k: v for k, v in d.items() if k not in ("kind", "tables")})
        if stored:
            spark = SparkSession.getActiveSession()
            model.tables = {c: spark.read.parquet(path) for c, path in stored.items()}
        return model


def _category_table(df: DataFrame, c: str, *aggs: Column) -> tuple[DataFrame, list | None]:
    """Categories of a column with their counts; collected only when few."""
    table = materialize(df.where(col(c).isNotNull()).groupBy(col(c)).agg(F.count("*").alias("__n"), *aggs), "categories")
    few = table.limit(INLINE_LIMIT + 1).collect()
    if len(few) > INLINE_LIMIT:
        return table, None
    return table, sorted(few, key=lambda r: _sort_key(r[0]))


def _sort_key(v: Any):
    """Spark orders strings by their UTF-8 bytes."""
    return v.encode("utf-8") if isinstance(v, str) else v


def fit_encoder(
    df: DataFrame, method: str = "label", columns: list[str] | None = None, drop_original: bool = True,
    handle_unknown: str = "ignore", order: dict[str, list[Any]] | None = None, target: str | None = None,
    smoothing: float = 0.0, max_values: int | None = None,
) -> EncodeModel:
    """Fit an encoder on the eligible columns.

    ``order`` gives ordinal categories their rank; without it they rank in
    ascending order. Target encoding uses (sum + m * mean) / (n + m).
    """
    method = method.lower()
    if method not in METHODS:
        raise UnsupportedOperationError(f"unknown encoding method: {method}")
    if handle_unknown not in ("ignore", "error"):
        raise UnsupportedOperationError(f"unknown handle_unknown: {handle_unknown}")
    if method == "target" and not target:
        raise DataValidationError("target encoding needs a target column")
    columns = [c for c in (columns or kinds.categorical_columns(df)) if c in df.columns and c != target]
    model = EncodeModel(method, drop_original=drop_original, handle_unknown=handle_unknown)
    if not columns:
        return model
    if max_values is None and method not in LIMITED:
        reasons = _single_values(df, columns)
    else:
        reasons = {r["column"]: r["reason"] for r in encode_eligibility(df, columns, method, max_values).collect()}
    model.skipped = {c: reasons[c] for c in columns if reasons[c]}
    columns = [c for c in columns if not reasons[c]]
    if method == "target":
        model.default = df.where(col(target).isNotNull()).agg(F.avg(col(target).cast("double"))).first()[0]
    for c in columns:
        if method == "ordinal" and order and c in order:
            model.classes[c] = list(order[c])
            continue
        if method == "target":
            known = df.where(col(target).isNotNull())
            mean = ((F.sum(col(target).cast("double")) + F.lit(smoothing * model.default))
                    / (F.count("*") + F.lit(smoothing)))
            table, few = _category_table(known, c, mean.alias("__code"))
        else:
            table, few = _category_table(df, c)
        if few is not None:
            model.classes[c] = [r[0] for r in few]
            if method == "target":
                model.means[c] = [r["__code"] for r in few]
            continue
        if method in ("ordinal", "label"):
            table = row_numbers(table, [c], "__code").withColumn("__code", (F.col("__code") - 1).cast("int"))
        model.tables[c] = table
    return model


def encode(df: DataFrame, method: str = "label", **options) -> DataFrame:
    return fit_encoder(df, method, **options).transform(df)
