"""Schema validation. All counting checks of all columns share one aggregate."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col, null_share
from sparktidy.plans.shape import column_counts, rows_from

VIOLATION = "column string, check string, severity string, message string, actual string, expected string"
SHOWN_VALUES = 5
SHOWN_ALLOWED = 10
MISSING_TOLERANCE = 5.0


@dataclass
class ColumnSchema:
    """Expected properties of one column."""

    name: str
    dtype: str | None = None
    nullable: bool = True
    max_missing_pct: float = 100.0
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: list[Any] | None = None

    def to_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "ColumnSchema":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in known})


@dataclass
class DataSchema:
    """Expected columns of a table."""

    columns: list[ColumnSchema] = field(default_factory=list)
    allow_extra_columns: bool = True
    require_all_columns: bool = True

    def to_dict(self) -> dict[str, Any]:
        return {"columns": [c.to_dict() for c in self.columns],
                "allow_extra_columns": self.allow_extra_columns,
                "require_all_columns": self.require_all_columns}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "DataSchema":
        flags = {k: d[k] for k in ("allow_extra_columns", "require_all_columns") if k in d}
        return cls([ColumnSchema.from_dict(c) for c in d.get("columns", [])], **flags)

    def to_json(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2), encoding="utf-8")

    @classmethod
    def from_json(cls, path: str | Path) -> "DataSchema":
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_yaml(cls, path: str | Path) -> "DataSchema":
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def load(cls, path: str | Path) -> "DataSchema":
        """Read JSON or YAML, by suffix."""
        return cls.from_yaml(path) if Path(path).suffix in (".yaml", ".yml") else cls.from_json(path)

    @classmethod
    def from_structtype(cls, schema: T.StructType) -> "DataSchema":
        return cls([ColumnSchema(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields])


@dataclass
class ValidationResult:
    """Collected violations; their number is bounded by columns x checks."""

    violations: list[dict[str, Any]]

    @property
    def errors(self) -> list[dict[str, Any]]:
        return [v for v in self.violations if v["severity"] == "error"]

    @property
    def warnings(self) -> list[dict[str, Any]]:
        return [v for v in self.violations if v["severity"] == "warning"]

    @property
    def passed(self) -> bool:
        return not self.errors

    def to_dict(self) -> dict[str, Any]:
        return {"passed": self.passed, "error_count": len(self.errors),
                "warning_count": len(self.warnings), "violations": self.violations}


def _violation(column: str, check: str, severity: str, message: Column, actual: Column, expected: str) -> Column:
    return F.struct(F.lit(column).alias("column"), F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                    message.alias("message"), actual.cast("string").alias("actual"), F.lit(expected).alias("expected"))


def _structure(df: DataFrame, schema: DataSchema) -> list[tuple]:
    """Checks the table's schema alone answers."""
    wanted = [c.name for c in schema.columns]
    found = []
    if schema.require_all_columns:
        found += [(c, "column_presence", "error", f"required column {c} is missing", None, None)
                  for c in sorted(set(wanted) - set(df.columns))]
    if not schema.allow_extra_columns:
        found += [(c, "extra_column", "warning", f"column {c} is not in the schema", None, None)
                  for c in sorted(set(df.columns) - set(wanted))]
    for c in schema.columns:
        if c.dtype is not None and c.name in df.columns and not kinds.same_dtype(df.schema[c.name].dataType, c.dtype):
            found.append((c.name, "dtype", "error", "dtype mismatch", kinds.dtype_name(df, c.name), c.dtype))
    return found


def _counted(df: DataFrame, specs: list[ColumnSchema]) -> DataFrame | None:
    """Null, uniqueness and range checks: one aggregate over all columns."""
    numeric = set(kinds.numeric_columns(df))
    aggs, tests, distinct = [F.count("*").alias("n")], [], {}
    n = F.col("n")
    for i, s in enumerate(specs):
        v, present = col(s.name), F.col(f"p{i}")
        ranged = s.name in numeric
        wants_nulls = not s.nullable or s.max_missing_pct < 100.0
        if wants_nulls or s.unique:
            aggs.append(F.count(v).alias(f"p{i}"))
        if not s.nullable:
            nulls = n - present
            tests.append(F.when(nulls > 0, _violation(
                s.name, "nullable", "error", F.format_string("%d null(s) where none are allowed", nulls), nulls, "0")))
        if s.max_missing_pct < 100.0:
            pct = null_share(n, present)
            tests.append(F.when(pct > s.max_missing_pct, _violation(
                s.name, "max_missing_pct", "warning", F.format_string("%.1f%% missing exceeds the limit", pct),
                F.format_string("%.1f%%", pct), f"≤{s.max_missing_pct:.1f}%")))
        if s.unique:
            distinct[s.name] = f"u{i}"
            extra = present - F.col(f"u{i}")
            tests.append(F.when(extra > 0, _violation(
                s.name, "unique", "error", F.format_string("%d duplicate value(s)", extra), F.col(f"u{i}"),
                "all values distinct")))
        if ranged and s.min_value is not None:
            aggs.append(F.min(v).alias(f"lo{i}"))
            tests.append(F.when(F.col(f"lo{i}") < F.lit(s.min_value), _violation(
                s.name, "min_value", "error", F.lit("minimum is below the limit"), F.col(f"lo{i}"), f"≥{s.min_value}")))
        if ranged and s.max_value is not None:
            aggs.append(F.max(v).alias(f"hi{i}"))
            tests.append(F.when(F.col(f"hi{i}") > F.lit(s.max_value), _violation(
                s.name, "max_value", "error", F.lit("maximum is above the limit"), F.col(f"hi{i}"), f"≤{s.max_value}")))
    if not tests:
        return None
    row = df.agg(*aggs)
    if distinct:  # counted in one pass over cells; several count(DISTINCT) would repeat every row
        counts = column_counts(df, list(distinct)).agg(*[
            F.max(F.when(F.col("column") == c, F.col("distinct"))).alias(u) for c, u in distinct.items()])
        row = row.withColumn("__one", F.lit(1)).join(F.broadcast(counts.withColumn("__one", F.lit(1))), "__one")
    return row.select(F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull())))


def _whitelisted(df: DataFrame, specs: list[ColumnSchema]) -> DataFrame | None:
    """Disallowed values: filtered first, then counted distinct."""
    listed = [s for s in specs if s.allowed_values is not None]
    if not listed:
        return None
    cells = F.array(*[
        F.when(~col(s.name).isin(list(s.allowed_values)),
               F.struct(F.lit(s.name).alias("column"), col(s.name).cast("string").alias("value"))) for s in listed])
    bad = (df.select(F.inline(F.filter(cells, lambda t: t.isNotNull())))
           .groupBy("column", "value").agg(F.count("*").alias("rows")))
    order = Window.partitionBy("column").orderBy("value")
    shown = (bad.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SHOWN_VALUES)
             .groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("actual")))
    counts = bad.groupBy("column").agg(F.count("*").alias("n"))
    expected = F.create_map(*[F.lit(x) for s in listed for x in (
        s.name, "one of " + ",".join(sorted(map(str, s.allowed_values))[:SHOWN_ALLOWED]))])
    return counts.join(F.broadcast(shown), "column").select(
        "column", F.lit("allowed_values").alias("check"), F.lit("error").alias("severity"),
        F.format_string("%d disallowed value(s)", F.col("n")).alias("message"), "actual",
        expected[F.col("column")].alias("expected"))


def violations(df: DataFrame, schema: DataSchema) -> DataFrame:
    """All violations as a table: ``column, check, severity, message, actual, expected``."""
    specs = [s for s in schema.columns if s.name in df.columns]
    out = df.sparkSession.createDataFrame(_structure(df, schema), VIOLATION)
    for part in (_counted(df, specs), _whitelisted(df, specs)):
        if part is not None:
            out = out.unionByName(part)
    return out


def validation_summary(df: DataFrame, schema: DataSchema) -> DataFrame:
    """One row: ``passed, error_count, warning_count``."""
    found = violations(df, schema)
    return found.agg(F.count_if(F.col("severity") == "error").alias("error_count"),
                     F.count_if(F.col("severity") == "warning").alias("warning_count")).select(
        (F.col("error_count") == 0).alias("passed"), "error_count", "warning_count")


def _as_schema(schema: DataSchema | dict[str, Any] | str | Path) -> DataSchema:
    if isinstance(schema, DataSchema):
        return schema
    return DataSchema.from_dict(schema) if isinstance(schema, dict) else DataSchema.load(schema)


@dataclass
class DataValidator:
    schema: DataSchema

    def validate(self, df: DataFrame) -> ValidationResult:
        return ValidationResult([r.asDict() for r in violations(df, self.schema).collect()])


def validate_data(df: DataFrame, schema: DataSchema | dict[str, Any] | str | Path) -> ValidationResult:
    return DataValidator(_as_schema(schema)).validate(df)


def schema_facts(df: DataFrame) -> DataFrame:
    """Per column: type, whether nulls occur, and the tolerated missing percentage."""
    wide = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
    n = F.col("n")
    return rows_from(wide, [{
        "name": F.lit(c), "dtype": F.lit(kinds.dtype_name(df, c)), "nullable": F.col(f"p{i}") < n,
        "max_missing_pct": F.round(null_share(n, F.col(f"p{i}")) + MISSING_TOLERANCE, 1), "unique": F.lit(False),
    } for i, c in enumerate(df.columns)])


def infer_schema(df: DataFrame) -> DataSchema:
    """A schema the table itself satisfies."""
    return DataSchema([ColumnSchema(r["name"], r["dtype"], r["nullable"], r["max_missing_pct"], r["unique"])
                       for r in schema_facts(df).collect()])
