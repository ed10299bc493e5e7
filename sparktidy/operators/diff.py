"""Comparing two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col, null_share
from sparktidy.plans.shape import rows_from


def diff_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shapes, matches, differing columns and a verdict (0 when schema
    and shape match)."""
    types_a = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    types_b = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    shared = sorted(types_a.keys() & types_b.keys())
    changed = [f"{c}:{types_a[c]}->{types_b[c]}" for c in shared if types_a[c] != types_b[c]]
    same_schema = types_a == types_b
    rows = (a.agg(F.count("*").alias("n")).select(F.lit("a").alias("side"), "n")
            .unionByName(b.agg(F.count("*").alias("n")).select(F.lit("b").alias("side"), "n"))
            .agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("rows_a"),
                 F.max(F.when(F.col("side") == "b", F.col("n"))).alias("rows_b")))
    same_shape = (F.col("rows_a") == F.col("rows_b")) & F.lit(len(types_a) == len(types_b))
    verdict = F.when(same_shape & F.lit(same_schema), 0).otherwise(1)
    return rows.select(
        "rows_a", "rows_b", F.lit(len(types_a)).cast("long").alias("columns_a"),
        F.lit(len(types_b)).cast("long").alias("columns_b"), same_shape.alias("shape_match"),
        F.lit(same_schema).alias("schema_match"),
        F.lit(",".join(sorted(types_a.keys() - types_b.keys()))).alias("columns_only_in_a"),
        F.lit(",".join(sorted(types_b.keys() - types_a.keys()))).alias("columns_only_in_b"),
        F.lit(",".join(changed)).alias("dtype_changes"), verdict.cast("int").alias("verdict"))


def diff_numeric(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and null percentage per shared numeric column: one aggregate per side."""
    shared = [c for c in kinds.numeric_columns(a) if c in set(kinds.numeric_columns(b))]

    def side(df: DataFrame, tag: str) -> DataFrame:
        wide = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(shared) for e in (
            F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0)).alias(f"m{i}"), F.count(col(c)).alias(f"p{i}"))])
        return rows_from(wide, [{"column": F.lit(c), f"mean_{tag}": F.col(f"m{i}"),
                                 f"null_pct_{tag}": null_share(F.col("n"), F.col(f"p{i}"))}
                                for i, c in enumerate(shared)])

    both = side(a, "a").join(F.broadcast(side(b, "b")), "column")
    return both.select(
        "column", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
        F.round(F.col("mean_b") - F.col("mean_a"), 4).alias("mean_delta"),
        F.round("null_pct_a", 2).alias("null_pct_a"), F.round("null_pct_b", 2).alias("null_pct_b"))
