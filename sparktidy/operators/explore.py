"""Exploration statistics."""

from __future__ import annotations

from itertools import combinations
from math import isfinite

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.config import get_config
from sparktidy.errors import UnsupportedOperationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col, correlation_label, finite, skew_label
from sparktidy.operators.kendall import kendall_pair
from sparktidy.plans.lookup import COLUMN, COUNT, VALUE, cell_counts, lookup_columns
from sparktidy.plans.ordering import running_total
from sparktidy.plans.quantiles import quantiles
from sparktidy.plans.sampling import hash_limit, key_bits
from sparktidy.plans.shape import long_cells, rows_from
from sparktidy.session import materialize

PAIR_COLUMNS = ("column1", "column2", "correlation")
# Above this width one vector aggregate replaces an aggregate per pair; the results are the same.
WIDE_COLUMNS = 12


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c).cast("double").alias(c) for c in columns])


def _corr(a: Column, b: Column) -> Column:
    """Pearson's r; null where it is undefined (a constant column, NaN or
    infinite values, no rows)."""
    r = finite(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs over the rows complete in every column, in one aggregate."""
    data = _doubles(df, columns).na.drop()
    pairs = list(combinations(columns, 2))
    if len(columns) > WIDE_COLUMNS:
        return _vector_pairs(data, columns)
    wide = data.agg(*[_corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return rows_from(wide, [{"column1": F.lit(a), "column2": F.lit(b), "correlation": F.col(f"r{i}")}
                            for i, (a, b) in enumerate(pairs)])


def _vector_pairs(data: DataFrame, columns: list[str]) -> DataFrame:
    """Gram-matrix correlation; the result is columns x columns, not rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    names = [f"c{i}" for i in range(len(columns))]
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(data.toDF(*names)).select("v")
    if not data.head(1):
        return data.sparkSession.createDataFrame([(a, b, None) for a, b in combinations(columns, 2)],
                                                 "column1 string, column2 string, correlation double")
    matrix = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
    rows = [(a, b, min(max(float(matrix[i][j]), -1.0), 1.0) if isfinite(matrix[i][j]) else None) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    return data.sparkSession.createDataFrame(rows, "column1 string, column2 string, correlation double")


def _ranked(data: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The average rank of every value in place of it. All columns are counted per
    value in one pass, ranked by one running sum over the counts, and ranked rows come
    from one lookup: no window holds rows, ties cost nothing, and the plan grows by a
    broadcast join per column."""
    values = [F.col(c) for c in columns]
    counts = materialize(cell_counts(data, values), "counts") if counts is None else counts
    upto = running_total(counts, F.col(COUNT), [COLUMN, VALUE], "upto", [COLUMN])
    # as text, since Spark deals joins on doubles anew, however they lie; 0.0 and -0.0 are one value
    kind = counts.schema[VALUE].dataType.simpleString()
    texts = [(v.cast(kind) + F.lit(0).cast(kind)).cast("string") for v in values]
    ranks = materialize(upto.select(COLUMN, (F.col(VALUE) + F.lit(0).cast(kind)).cast("string").alias(VALUE), COUNT, (
        F.col("upto") - (F.col(COUNT) - 1) / 2.0).alias("rank")), "ranks")
    names = [f"rank_{c}" for c in columns]
    return lookup_columns(data, texts, ranks, "rank", names, ranks).select(
        *[F.col(n).alias(c) for n, c in zip(names, columns)])


def _spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of average ranks. Columns without nulls are ranked once
    and correlated in one aggregate; other pairs rank the rows they share."""
    names = [f"c{i}" for i in range(len(columns))]
    data = _doubles(df, columns).toDF(*names)
    data = data.select(*[F.when(F.isnan(n), None).otherwise(F.col(n) + F.lit(0.0)).alias(n) for n in names])
    counts = materialize(cell_counts(data, [F.col(n) for n in names]), "counts")
    present = {r[COLUMN]: r["n"] for r in counts.groupBy(COLUMN).agg(F.sum(COUNT).alias("n")).collect()}
    rows = data.count()
    full = [n for i, n in enumerate(names) if rows and present.get(i) == rows]
    number = F.array_position(F.array(*[F.lit(i) for i, n in enumerate(names) if n in full]), F.col(COLUMN)) - 1
    of_full = counts.withColumn(COLUMN, number.cast("int")).where(F.col(COLUMN) >= 0) if full else None
    groups = [full] if len(full) > 1 else []
    groups += [[a, b] for a, b in combinations(names, 2) if a not in full or b not in full]
    of, out = dict(zip(names, columns)), None
    for group in groups:
        # no filter over all columns where none is needed: its constraints double with each alias
        ranked = _ranked(data.select(*group), group, of_full) if group is full else _ranked(data.select(*group).na.drop(), group)
        if len(group) > WIDE_COLUMNS:
            names_back = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
            out = _vector_pairs(ranked, group).select(names_back[F.col("column1")].alias("column1"),
                                                      names_back[F.col("column2")].alias("column2"), "correlation")
            continue
        pairs = list(combinations(group, 2))
        wide = ranked.agg(*[_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        part = rows_from(wide, [{"column1": F.lit(of[a]), "column2": F.lit(of[b]), "correlation": F.col(f"r{i}")}
                                for i, (a, b) in enumerate(pairs)])
        out = part if out is None else out.unionByName(part)
    return out


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """``column1, column2, correlation`` for every pair of numeric columns.
    Pearson drops rows with any null, the rank methods drop nulls per pair."""
    columns = columns or kinds.numeric_columns(df)
    if method == "pearson":
        return _pearson_pairs(df, columns)
    if method == "spearman":
        return _spearman_pairs(df, columns)
    if method != "kendall":
        raise UnsupportedOperationError(f"unknown correlation method: {method}")
    out = None
    for a, b in combinations(columns, 2):
        part = kendall_pair(df, a, b).select(F.lit(a).alias("column1"), F.lit(b).alias("column2"), "correlation")
        out = part if out is None else out.unionByName(part)
    return out


def correlations(
    df: DataFrame, columns: list[str] | None = None, method: str = "pearson", min_correlation: float = 0.1
) -> DataFrame:
    """Pairs whose absolute correlation reaches the threshold, strongest first."""
    r = F.col("correlation")
    return (correlation_pairs(df, columns, method).where(F.abs(r) >= min_correlation)
            .select("column1", "column2", "correlation", F.abs(r).alias("abs_correlation"),
                    correlation_label(r).alias("strength"))
            .orderBy(F.desc("abs_correlation"), "column1", "column2"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """The full symmetric matrix in long form, diagonal included."""
    columns = columns or kinds.numeric_columns(df)
    pairs = correlation_pairs(df, columns, method)
    both = F.array(F.struct("column1", "column2", "correlation"),
                   F.struct(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "correlation"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns],
                                               "column1 string, column2 string, correlation double")
    return pairs.select(F.inline(both)).unionByName(diagonal)


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of two columns over rows where both are present, with its label."""
    both = _doubles(df, [x, y]).toDF("x", "y").na.drop()
    out = both.agg(F.count("*").alias("n"), _corr(F.col("x"), F.col("y")).alias("correlation"))
    return out.withColumn("strength", correlation_label(F.col("correlation")))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], n: int = 1000, seed: int | None = None) -> DataFrame:
    """``n`` rows with both values, chosen by a seeded hash of a unique key, so
    the choice does not depend on how the table is partitioned."""
    seed = get_config().random_state if seed is None else seed
    pick = key_bits([col(k) for k in key], seed)
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    near = both.where(pick <= F.lit(hash_limit(both.count(), n)))
    return (near.orderBy(pick, *[col(k) for k in key]).limit(n)
            .select(*[col(c) for c in dict.fromkeys([*key, x, y])]))


def distributions(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Moments and quartiles per numeric column; population std, biased skewness
    and excess kurtosis, linear quartiles."""
    columns = columns or kinds.numeric_columns(df)
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75], accuracy)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_pop, "skewness": F.skewness,
             "kurtosis": F.kurtosis, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(col(c).cast("double")).alias(f"{name}{i}")
                    for i, c in enumerate(columns) for name, fn in stats.items()])
    records = []
    for i, c in enumerate(columns):
        q25, median, q75 = (F.lit(v).cast("double") for v in cuts[c])
        records.append({"column": F.lit(c), **{name: F.col(f"{name}{i}") for name in stats},
                        "range": F.col(f"max{i}") - F.col(f"min{i}"),
                        "q25": q25, "median": median, "q75": q75, "iqr": q75 - q25})
    return rows_from(wide, records)


def skew_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or kinds.numeric_columns(df)
    wide = df.agg(*[F.skewness(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    return rows_from(wide, [{"column": F.lit(c), "skewness": F.col(f"s{i}"),
                             "label": skew_label(F.col(f"s{i}"))} for i, c in enumerate(columns)])


def categorical_analysis(
    df: DataFrame, columns: list[str] | None = None, max_categories: int | None = None
) -> DataFrame:
    """Top categories per text column with their share of the non-null values.
    Everything derives from one grouped count."""
    columns = columns or kinds.categorical_columns(df)
    k = max_categories or get_config().max_categories_plot
    counts = long_cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("count"))
    present = F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0)
    totals = counts.groupBy("column").agg(
        F.count("*").alias("unique_count"), F.sum(present).alias("total_count"),
        F.sum(F.col("count") - present).alias("missing_count"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    top = (counts.where(F.col("value").isNotNull())
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return top.join(F.broadcast(totals), "column").withColumn("share", F.col("count") / F.col("total_count"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with counts, empty bins included. NaN and infinite
    values are in no bin; ``not_finite`` says how many there are."""
    v = finite(col(column).cast("double"))
    lo, hi, odd = df.agg(F.min(v), F.max(v), F.count_if(col(column).isNotNull() & v.isNull())).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long, not_finite long")
    width = (hi - lo) / bins
    spot = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counts = df.where(v.isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("count"))
    frame = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("lower"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("upper"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.lit(odd).cast("long").alias("not_finite"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class, with the largest-to-smallest ratio."""
    counts = (df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count("*").alias("count"))
              .withColumn("__one", F.lit(1)))
    whole = counts.groupBy("__one").agg(
        F.sum("count").alias("__n"), F.max("count").alias("__hi"), F.min("count").alias("__lo"))
    return counts.join(F.broadcast(whole), "__one").select(
        "class", "count", (F.col("count") / F.col("__n")).alias("share"),
        (F.col("__hi") / F.col("__lo")).alias("imbalance_ratio"))
