"""Type conversion, text repair and constraint checks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import TEXT_OPERATIONS, col, parse_bool, strip
from sparktidy.plans.shape import rows_from

# Accepted names of the target types.
TARGETS = {
    "int": "bigint", "integer": "bigint",
    "float": "double", "double": "double",
    "str": "string", "string": "string", "text": "string",
    "bool": "boolean", "boolean": "boolean",
    "date": "timestamp", "datetime": "timestamp",
}


# Text that can be a number at all: a failed parse costs far more than a pattern test.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def parsed(c: Column, spark_type: str) -> Column:
    """A text column as a number, null where it does not read as one."""
    return F.when(c.rlike(WHOLE if spark_type == "bigint" else NUMBER), c.try_cast(spark_type))


def converted(df: DataFrame, column: str, target: str, trim: bool = False) -> Column | None:
    """The column as the target type, null where a value does not fit; None for
    an unknown target name."""
    spark_type = TARGETS.get(target.lower())
    if spark_type is None:
        return None
    c, is_text = col(column), kinds.kind_of(df.schema[column].dataType) == kinds.CATEGORICAL
    if is_text and trim:
        c = strip(c)
    if is_text and spark_type == "boolean":
        return parse_bool(c)
    if is_text and spark_type == "timestamp":
        return F.try_to_timestamp(c)
    if is_text and spark_type in ("bigint", "double"):
        return parsed(c, spark_type)
    return c.try_cast(spark_type)


def _new_nulls(df: DataFrame, wanted: dict[str, str], trim: bool) -> dict[str, int | None]:
    exprs = {c: converted(df, c, t, trim) for c, t in wanted.items()}
    known = [c for c, e in exprs.items() if e is not None]
    if not known:
        return {c: None for c in wanted}
    row = df.agg(*[F.count_if(col(c).isNotNull() & exprs[c].isNull()) for c in known]).first()
    return {**{c: None for c in wanted}, **dict(zip(known, row))}


def convert_types(
    df: DataFrame, type_map: dict[str, str], strict: bool = True, trim: bool = False
) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Convert columns. Strict conversion leaves a column alone when any value
    would be lost; otherwise such values become null. Returns the table and one
    record per column: ``column, original, new, status, new_nulls``."""
    wanted = {c: t for c, t in type_map.items() if c in df.columns and TARGETS.get(t.lower()) != kinds.dtype_name(df, c)}
    lost = _new_nulls(df, wanted, trim) if wanted else {}
    report, changes = [], {}
    for c, t in wanted.items():
        ok = lost[c] is not None and (lost[c] == 0 or not strict)
        if ok:
            changes[c] = converted(df, c, t, trim)
        report.append({"column": c, "original": kinds.dtype_name(df, c), "new": TARGETS.get(t.lower(), t),
                       "status": "converted" if ok else "failed", "new_nulls": lost[c]})
    return (df.withColumns(changes) if changes else df), report


def type_suggestions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Suggested type of each text column (int, float or none), from all rows."""
    columns = columns or kinds.categorical_columns(df)
    aggs = [e for i, c in enumerate(columns) for e in (
        F.count(col(c)).alias(f"n{i}"),
        F.count(parsed(col(c), "bigint")).alias(f"l{i}"), F.count(parsed(col(c), "double")).alias(f"d{i}"))]
    wide = df.agg(*aggs)
    records = []
    for i, c in enumerate(columns):
        n = F.col(f"n{i}")
        suggestion = (F.when(n == 0, "none").when(F.col(f"l{i}") == n, "int")
                      .when(F.col(f"d{i}") == n, "float").otherwise("none"))
        records.append({"column": F.lit(c), "suggested": suggestion})
    return rows_from(wide, records)


def auto_convert(df: DataFrame, skip: list[str] = ()) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Convert the text columns whose every value reads as a number."""
    columns = [c for c in kinds.categorical_columns(df) if c not in skip]
    if not columns:
        return df, []
    found = {r["column"]: r["suggested"] for r in type_suggestions(df, columns).collect() if r["suggested"] != "none"}
    if not found:
        return df, []
    out = df.withColumns({c: converted(df, c, t) for c, t in found.items()})
    report = [{"column": c, "original": "string", "new": TARGETS[t], "status": "auto_converted", "new_nulls": 0}
              for c, t in found.items()]
    return out, report


def cast_preview(df: DataFrame, column: str, target: str, key: list[str], failed_only: bool = False) -> DataFrame:
    """Value before and after a trimmed, lenient conversion with its status."""
    new = converted(df, column, target, trim=True)
    if new is None:
        raise UnsupportedOperationError(f"unknown target type: {target}")
    status = (F.when(col(column).isNull(), "null").when(F.col("after").isNull(), "failed").otherwise("ok"))
    out = df.select(*[col(k) for k in key], col(column).alias("before"), new.alias("after"), col(column))
    out = out.withColumn("status", status).drop(column)
    return out.where(F.col("status") == "failed") if failed_only else out


def clean_text(
    df: DataFrame, columns: list[str] | None = None, operations: list[str] | None = None, unicode: bool = False
) -> DataFrame:
    """Apply text operations in order; one projection, no shuffle."""
    operations = operations if operations is not None else ["strip", "normalize_whitespace"]
    unknown = [o for o in operations if o not in TEXT_OPERATIONS]
    if unknown:
        raise UnsupportedOperationError(f"unknown text operations: {unknown}")
    columns = kinds.categorical_columns(df) if columns is None else [c for c in columns if c in df.columns]
    changes = {}
    for c in columns:
        e = col(c)
        for o in operations:
            fn = TEXT_OPERATIONS[o]
            e = fn(e, unicode) if unicode and o in ("strip", "normalize_whitespace") else fn(e)
        changes[c] = e
    return df.withColumns(changes) if changes else df


def constraint_violations(df: DataFrame, constraints: dict[str, dict[str, Any]], key: list[str]) -> DataFrame:
    """Key, column and broken rules of every violating cell. Nulls never violate."""
    cells = []
    for c, rules in constraints.items():
        if c not in df.columns:
            continue
        v, tests = col(c), []
        if "min_value" in rules:
            tests.append(("min_value", v < F.lit(rules["min_value"])))
        if "max_value" in rules:
            tests.append(("max_value", v > F.lit(rules["max_value"])))
        if "allowed_values" in rules:
            tests.append(("allowed_values", ~v.isin(list(rules["allowed_values"]))))
        if "regex_pattern" in rules:
            tests.append(("regex_pattern", ~v.rlike(rules["regex_pattern"])))
        broken = F.concat_ws(",", *[F.when(test, name) for name, test in tests])
        cells.append(F.when(broken != "", F.struct(F.lit(c).alias("column"), broken.alias("rules"))))
    if not cells:
        return df.select(*[col(k) for k in key], F.lit("").alias("column"), F.lit("").alias("rules")).limit(0)
    found = F.filter(F.array(*cells), lambda s: s.isNotNull())
    return df.select(*[col(k) for k in key], F.inline(found))
