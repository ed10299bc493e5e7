"""Profiling: what is in a table and how clean is it.

Each function is one whole-table aggregate (plus quantile jobs where exact
quantiles are asked for) whose single result row is laid out as a report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col, null_share
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.shape import column_counts, long_cells, rows_from
from sparktidy.session import materialize

# Candidates per column, and what a sketch of so many may leave out of n rows, in n / TRACKED:
# an item missing from the sketch has at most 3.5 shares, one left out by its lower bound twice that.
TRACKED, MISSED = 4096, 7.0


def _hashable(df: DataFrame) -> DataFrame:
    """Map columns cannot be grouped; their JSON text can."""
    return df.select(*[
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else col(f.name)
        for f in df.schema.fields])


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, ``distinct_rows``, ``duplicate_rows`` (extra copies)
    and ``duplicate_members`` (every row that has a copy). Copies collapse on
    the map side, so a row repeated many times does not make a hot task."""
    names = [col(c) for c in df.columns]
    groups = _hashable(df).groupBy(*names).agg(F.count("*").alias("__copies"))
    copies = F.col("__copies")
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum(copies), zero).alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(copies - 1), zero).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(copies > 1, copies)), zero).alias("duplicate_members"),
    )


def basic_info(df: DataFrame) -> DataFrame:
    """Row, column, null and duplicate counts of the table in one row.
    Null cells are counted on the distinct rows, weighted by their copies, so
    one shuffle serves every number."""
    nulls = reduce(Column.__add__, [col(c).isNull().cast("long") for c in df.columns])
    groups = _hashable(df).groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__copies"))
    copies = F.col("__copies")
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum(copies), zero).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum(copies * nulls), zero).alias("missing_values_total"),
        F.coalesce(F.sum(copies - 1), zero).alias("duplicate_rows"),
        F.lit(len(kinds.numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(kinds.categorical_columns(df))).cast("long").alias("categorical_columns"),
        F.lit(len(kinds.datetime_columns(df))).cast("long").alias("datetime_columns"),
    )


def column_profiles(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: type, missing and unique counts. A null counts as one
    unique value. ``approx`` swaps the exact distinct counts for sketches."""
    columns = columns or df.columns
    facts = column_counts(_hashable(df), columns, approx)
    n, present = F.col("n"), F.col("present")
    unique = F.col("distinct") + F.when(present < n, 1).otherwise(0)
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds.kind_of(df.schema[c].dataType))])
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds.dtype_name(df, c))])
    return facts.select(
        "column", dtype[F.col("column")].alias("dtype"), kind[F.col("column")].alias("kind"), n.alias("n_rows"),
        (n - present).alias("missing_count"), null_share(n, present).alias("missing_pct"),
        unique.alias("unique_count"), F.coalesce(F.try_divide(unique * 100.0, n), F.lit(0.0)).alias("unique_pct"))


def sample_values(df: DataFrame, order_by: list[str], n: int = 5, columns: list[str] | None = None) -> DataFrame:
    """First ``n`` non-null values per column along ``order_by``, as text.
    The rank filter runs before the shuffle, so each task sends n rows per column."""
    columns = columns or df.columns
    cells = long_cells(df.select(
        *[col(c) for c in columns], *[col(o).alias(f"__o{i}") for i, o in enumerate(order_by)]),
        columns, [f"__o{i}" for i in range(len(order_by))])
    order = Window.partitionBy("column").orderBy(*[f"__o{i}" for i in range(len(order_by))])
    return (cells.where(F.col("value").isNotNull())
            .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
            .select("column", "position", "value"))


def numeric_summary(
    df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of the non-null values."""
    columns = columns or kinds.numeric_columns(df)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], accuracy)
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    return rows_from(wide, [{
        "column": F.lit(c), "count": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}"),
        "min": F.col(f"lo{i}"), "q25": F.lit(cuts[c][0]).cast("double"),
        "median": F.lit(cuts[c][1]).cast("double"), "q75": F.lit(cuts[c][2]).cast("double"),
        "max": F.col(f"hi{i}"),
    } for i, c in enumerate(columns)])


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent non-null values per column, count descending then
    value ascending.

    One pass of mergeable frequent-item sketches over hashes of the values names at most
    ``tracked`` candidates a column, and a second pass counts their values exactly. That
    is the answer where the candidates hold every row, or where the k-th count is above
    what the sketch can have missed. Other columns are counted value by value."""
    columns = columns or kinds.categorical_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    counts, settled = _candidate_counts(df, columns, k, max(tracked, k))
    rest = [c for c in columns if c not in settled]
    if rest:
        every = (long_cells(df, rest).where(F.col("value").isNotNull())
                 .groupBy("column", "value").agg(F.count("*").alias("count")))
        counts = counts.where(F.col("column").isin(settled)).unionByName(every) if settled else every
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _candidate_counts(df: DataFrame, columns: list[str], k: int, tracked: int) -> tuple[DataFrame | None, list[str]]:
    """Exact ``column, value, count`` of the sketches' candidates, and the columns whose
    answer they hold. Equal values have equal hashes, so a value is at most as frequent
    as its hash; values that share a hash are counted apart."""
    hashes = df.select(*[F.when(col(c).isNotNull(), F.xxhash64(col(c).cast("string"))).alias(f"h{i}")
                         for i, c in enumerate(columns)])
    told = hashes.agg(*[x for i in range(len(columns)) for x in (
        F.count(f"h{i}").alias(f"n{i}"),
        F.expr(f"approx_top_k(h{i}, {tracked}, {tracked}) FILTER (WHERE h{i} IS NOT NULL)").alias(f"t{i}"))]).first()
    missed, hopeful = {}, []
    for i, c in enumerate(columns):
        rows, items = told[f"n{i}"], told[f"t{i}"] or []
        missed[c] = MISSED * rows / tracked
        # estimates are never too low: a full sketch whose k-th is small cannot settle
        if 2 * len(items) < tracked or (len(items) >= k and items[k - 1]["count"] > missed[c]):
            hopeful.append((i, c))
    if not hopeful:
        return None, []
    spark = df.sparkSession
    named = spark.createDataFrame([(c, x["item"]) for i, c in hopeful for x in told[f"t{i}"] or []], "column string, h long")
    met = long_cells(df, [c for _, c in hopeful]).where(F.col("value").isNotNull()).withColumn("h", F.xxhash64("value")).join(
        F.broadcast(named), ["column", "h"], "left_semi")
    counts = materialize(met.groupBy("column", "value").agg(F.count("*").alias("count")), "candidates")
    ordered = F.sort_array(F.collect_list("count"), asc=False)  # as many as there are candidates
    found = {r["column"]: r for r in counts.groupBy("column").agg(
        F.sum("count").alias("rows"), F.get(ordered, F.lit(k - 1)).alias("kth")).collect()}
    settled = []
    for i, c in hopeful:
        rows, kth = (found[c]["rows"], found[c]["kth"]) if c in found else (0, None)
        if rows == told[f"n{i}"] or (kth is not None and kth > missed[c]):
            settled.append(c)
    return counts, settled


def quality_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: missing and duplicate totals, the five worst columns and the
    type distribution."""
    n_cols = len(df.columns)
    present = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
    missing = [(F.col("n") - F.col(f"p{i}")) for i in range(n_cols)]
    total = reduce(Column.__add__, missing)
    ranked = F.array_sort(F.filter(
        F.array(*[F.struct((-m).alias("neg"), F.lit(c).alias("column")) for m, c in zip(missing, df.columns)]),
        lambda s: s["neg"] < 0))
    worst = F.array_join(F.transform(F.slice(ranked, 1, 5), lambda s: s["column"]), ",")
    spread: dict[str, int] = {}
    for f in df.schema.fields:
        name = f.dataType.simpleString()
        spread[name] = spread.get(name, 0) + 1
    left = present.select(
        F.lit(1).alias("__one"),
        reduce(Column.__add__, [(m > 0).cast("long") for m in missing]).alias("columns_with_missing"),
        total.alias("total_missing_cells"),
        F.coalesce(F.try_divide(total * 100.0, F.col("n") * n_cols), F.lit(0.0)).alias("missing_pct"),
        worst.alias("worst_columns"),
        F.lit(",".join(f"{k}:{v}" for k, v in sorted(spread.items()))).alias("type_distribution"),
    )
    right = duplicate_counts(df).select(
        F.lit(1).alias("__one"), "duplicate_rows",
        F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("duplicate_pct"),
        F.col("distinct_rows").alias("unique_rows"))
    return left.join(F.broadcast(right), "__one").drop("__one")


# Limits of the issue rules.
HIGH_MISSING, MODERATE_MISSING = 50.0, 20.0
ID_UNIQUE_PCT, ID_UNIQUE_COUNT = 95.0, 100
HIGH_DUPLICATES, MEDIUM_DUPLICATES = 10.0, 1.0
ADVICE = {
    "high_missing_values": "mostly empty: leave it out, or fill it from other columns",
    "moderate_missing_values": "fill the gaps before modelling",
    "constant_column": "one value throughout: it separates nothing",
    "potential_id_column": "nearly every value is its own: looks like a key, not a feature",
    "duplicate_rows": "some rows are repeated: deduplicate",
}


def detect_issues(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rule-based findings: ``type, severity, column, details, recommendation``."""
    p = column_profiles(df, approx=approx)
    pct, unique, unique_pct = F.col("missing_pct"), F.col("unique_count"), F.col("unique_pct")

    def issue(kind: str, severity, details: Column):
        return F.struct(F.lit(kind).alias("type"), (F.lit(severity) if isinstance(severity, str) else severity)
                        .alias("severity"), F.col("column").alias("column"), details.alias("details"),
                        F.lit(ADVICE[kind]).alias("recommendation"))

    found = F.array(
        F.when(pct > HIGH_MISSING, issue("high_missing_values", "high", F.format_string("%.1f%% missing values", pct)))
        .when(pct > MODERATE_MISSING,
              issue("moderate_missing_values", "medium", F.format_string("%.1f%% missing values", pct))),
        F.when(unique == 1, issue("constant_column", "medium", F.lit("Column has only one unique value"))),
        F.when((unique_pct > ID_UNIQUE_PCT) & (unique > ID_UNIQUE_COUNT),
               issue("potential_id_column", "low", F.format_string("%.1f%% unique values", unique_pct))),
    )
    by_column = p.select(F.inline(F.filter(found, lambda s: s.isNotNull())))
    d = duplicate_counts(df).where(F.col("duplicate_rows") > 0).withColumn(
        "pct", F.col("duplicate_rows") * 100.0 / F.col("n_rows"))
    whole = d.select(
        F.lit("duplicate_rows").alias("type"),
        F.when(F.col("pct") > HIGH_DUPLICATES, "high").when(F.col("pct") > MEDIUM_DUPLICATES, "medium")
        .otherwise("low").alias("severity"),
        F.lit("entire_dataset").alias("column"),
        F.format_string("%,d duplicate rows (%.1f%%)", F.col("duplicate_rows"), F.col("pct")).alias("details"),
        F.lit(ADVICE["duplicate_rows"]).alias("recommendation"))
    return by_column.unionByName(whole)


def _width(dtype: T.DataType, c: Column) -> Column:
    fixed = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
             T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}
    for t, w in fixed.items():
        if isinstance(dtype, t):
            return F.when(c.isNotNull(), w)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(dtype, T.ArrayType):
        inner = F.aggregate(F.transform(c, lambda x: F.coalesce(_width(dtype.elementType, x), F.lit(0)).cast("long")),
                            F.lit(0).cast("long"), lambda a, b: a + b)
        return F.when(c.isNotNull(), inner)
    return F.octet_length(F.to_json(c))


def column_bytes(df: DataFrame) -> DataFrame:
    """Logical bytes of the non-null values per column."""
    wide = df.agg(*[F.coalesce(F.sum(_width(f.dataType, col(f.name)).cast("long")), F.lit(0).cast("long"))
                    .alias(f"b{i}") for i, f in enumerate(df.schema.fields)])
    return rows_from(wide, [{"column": F.lit(c), "bytes": F.col(f"b{i}")} for i, c in enumerate(df.columns)])


def inspect_table(df: DataFrame) -> DataFrame:
    """One row per column with the table's shape, type and missing percentage."""
    wide = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
    return rows_from(wide, [{
        "rows": F.col("n"), "columns": F.lit(len(df.columns)).cast("long"), "column": F.lit(c),
        "dtype": F.lit(kinds.dtype_name(df, c)),
        "missing_pct": F.round(null_share(F.col("n"), F.col(f"p{i}")), 2),
    } for i, c in enumerate(df.columns)])


def inspect_json(df: DataFrame) -> DataFrame:
    """The same facts as one JSON document."""
    cells = F.struct("column", "dtype", "missing_pct")
    return (inspect_table(df).groupBy("rows", "columns")
            .agg(F.sort_array(F.collect_list(cells)).alias("fields"))
            .select(F.to_json(F.struct("rows", "columns", "fields")).alias("json")))


def profile_report(
    df: DataFrame, order_by: list[str], sample_rows: int = 10, max_cat_values: int = 10, approx: bool = False
) -> dict[str, DataFrame]:
    """The named tables of a full report."""
    from sparktidy.operators.explore import correlation_matrix

    shape = df.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)])
    cells = F.col("rows") * len(df.columns)
    missing = cells - reduce(Column.__add__, [F.col(f"p{i}") for i in range(len(df.columns))])
    overview = (
        shape.select(F.lit(1).alias("__one"), "rows", F.lit(len(df.columns)).cast("long").alias("cols"),
                     missing.alias("missing_cells"),
                     F.round(F.coalesce(F.try_divide(missing * 100.0, cells), F.lit(0.0)), 2).alias("missing_pct"))
        .join(F.broadcast(duplicate_counts(df).select(
            F.lit(1).alias("__one"), F.col("duplicate_members").alias("duplicate_rows"))), "__one").drop("__one"))
    profiles = column_profiles(df, approx=approx).select(
        F.col("column").alias("name"), "dtype", "kind", F.col("missing_count").alias("null_count"),
        F.round("missing_pct", 2).alias("null_pct"), F.col("unique_count").alias("unique"))
    numeric = kinds.numeric_columns(df)
    report = {"overview": overview, "columns": profiles,
              "top_values": top_values(df, k=max_cat_values),
              "sample": df.orderBy(*[col(o) for o in order_by]).limit(sample_rows)}
    if numeric:
        facts = numeric_summary(df, numeric)
        rounded = facts.select(F.col("column").alias("name"), *[
            F.round(m, 4).alias(m) for m in ("mean", "std", "min", "q25", "median", "q75", "max")])
        report["columns"] = profiles.join(F.broadcast(rounded), "name", "left")
    if len(numeric) > 1:
        report["correlations"] = correlation_matrix(df, numeric).withColumn("correlation", F.round("correlation", 3))
    return report
