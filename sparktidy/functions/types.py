"""Column classes, read from the schema alone (no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, OTHER = "numeric", "categorical", "datetime", "boolean", "other"

# Dtype names a schema file may use, with the Spark types they stand for.
DTYPE_ALIASES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float32": "float",
    "float64": "double",
    "utf8": "string",
    "str": "string",
    "string": "string",
    "categorical": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "integer": "int",
    "long": "bigint",
    "short": "smallint",
    "byte": "tinyint",
}


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.TimeType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, CATEGORICAL)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, DATETIME)


def boolean_columns(df: DataFrame) -> list[str]:
    return columns_of(df, BOOLEAN)


def dtype_name(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def same_dtype(dtype: T.DataType, expected: str) -> bool:
    """Does a Spark type satisfy a dtype name from a schema file?"""
    actual, wanted = dtype.simpleString(), expected.strip().lower()
    if wanted.startswith(("datetime", "timestamp")):
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) and wanted in (
            "datetime", "timestamp", actual)
    return actual == DTYPE_ALIASES.get(wanted, wanted)
