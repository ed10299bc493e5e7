"""Turning one wide aggregate row into a long report, and rows into long cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.functions.exprs import col


def rows_from(df: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Emit one output row per record from every row of ``df`` (usually the
    single row of a whole-table aggregate)."""
    structs = [F.struct(*[e.alias(name) for name, e in r.items()]) for r in records]
    return df.select(F.inline(F.array(*structs)))


def long_cells(df: DataFrame, columns: list[str], keep: list[str] = (), cast: str = "string") -> DataFrame:
    """``column, value`` per cell, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in columns])
    return df.select(*[col(k) for k in keep], F.inline(cells))


def column_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """``column, n, present, distinct`` per column.

    Exact distinct counts come from one scan and one shuffle whatever the number
    of columns: every cell becomes its column's number and a 128-bit hash, and
    equal cells combine before the shuffle, so neither rows nor long values are
    repeated. Sketches share one pass as well.
    """
    if approx:
        wide = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(columns) for e in (
            F.count(col(c)).alias(f"p{i}"), F.approx_count_distinct(col(c)).alias(f"d{i}"))])
        return rows_from(wide, [{"column": F.lit(c), "n": F.col("n"), "present": F.col(f"p{i}"),
                                 "distinct": F.col(f"d{i}")} for i, c in enumerate(columns)])
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n long, present long, distinct long")
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    plain = [col(c) + F.lit(0.0) if c in floats else col(c) for c in columns]  # 0.0 and -0.0 are one value
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(v).alias("h"), F.xxhash64(F.lit(7), v).alias("g"),
                               v.isNotNull().alias("some")) for i, v in enumerate(plain)])
    counted = df.select(F.inline(cells)).groupBy("i", "h", "g", "some").agg(F.count("*").alias("n"))
    facts = counted.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("some"), F.col("n")).otherwise(0)).alias("p"),
                                     F.count_if("some").alias("d"))
    zero = F.lit(0).cast("long")
    names = df.sparkSession.range(len(columns)).select(
        F.col("id").alias("at"), F.array(*map(F.lit, columns))[F.col("id").cast("int")].alias("column"))
    return names.join(F.broadcast(facts), F.col("at") == F.col("i"), "left").select(
        "column", F.coalesce("n", zero).alias("n"), F.coalesce("p", zero).alias("present"),
        F.coalesce("d", zero).alias("distinct"))
