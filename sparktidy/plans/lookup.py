"""Joining rows with a per-value table when some values are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparktidy.functions.exprs import col
from sparktidy.session import materialize

HOT_LIMIT = 1000
# The same for all columns of a lookup together, and the cells that meet the map in one task.
HOT_CELLS, TASK_CELLS = 10_000, 500_000
# Long-form cells: the column's number, the value, how many rows hold it, the row's number.
COLUMN, VALUE, COUNT, ROW = "__i", "__v", "__n", "__row"


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join ``df`` with ``table`` (one row per ``key`` value, carrying the
    value's row count in ``weight``). Null keys match nothing.

    The HOT_LIMIT most frequent values of ``df`` itself (on a stream: of the
    table, by weight), known to the table or not, are matched by a broadcast of
    as many rows. Their rows and those without a key are not shuffled at all;
    only the others meet the table in a shuffle join, where no value is frequent.
    """
    payload = [c for c in table.columns if c not in (key, weight)]
    if df.isStreaming:
        most = table.select(col(key).alias("__hot_key"), col(weight).alias("__freq"))
    else:
        most = df.where(col(key).isNotNull()).groupBy(col(key).alias("__hot_key")).agg(F.count("*").alias("__freq"))
    most = most.orderBy(F.desc("__freq"), "__hot_key").limit(HOT_LIMIT).select("__hot_key")
    known = table.select(col(key).alias("__known"), *[col(c).alias(f"__of_{c}") for c in payload])
    hot = most.join(known, F.col("__hot_key") == F.col("__known"), "left").drop("__known").withColumn("__hot", F.lit(True))
    tagged = df.join(F.broadcast(hot), col(key) == F.col("__hot_key"), "left")
    served = F.col("__hot").isNotNull() | col(key).isNull()
    names = [col(c) for c in df.columns]
    done = tagged.where(served).select(*names, *[F.col(f"__of_{c}").alias(c) for c in payload])
    rest = tagged.where(~served).select(*names).join(known, col(key) == F.col("__known"), "left")
    return done.unionByName(rest.select(*names, *[F.col(f"__of_{c}").alias(c) for c in payload]))


def cell(df: DataFrame, c: str) -> Column:
    """A column's value as text that is equal where the values are equal, so that
    columns of different types share one long-form map."""
    kind, value = df.schema[c].dataType, col(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")  # 0.0 and -0.0 are one value
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def cells(df: DataFrame, values: list[Column], *keep: str) -> DataFrame:
    """One row per value that is not null: its column's number and the value."""
    told = F.array(*[F.struct(F.lit(i).alias(COLUMN), v.alias(VALUE)) for i, v in enumerate(values)])
    return df.select(*keep, F.inline(told)).where(F.col(VALUE).isNotNull())


def cell_counts(df: DataFrame, values: list[Column]) -> DataFrame:
    """Rows per column and value, for all columns in one pass."""
    return cells(df, values).groupBy(COLUMN, VALUE).agg(F.count("*").alias(COUNT))


def lookup_columns(df: DataFrame, values: list[Column], table: DataFrame, payload: str, names: list[str],
                   counts: DataFrame | None = None) -> DataFrame:
    """Left join of several columns with one long-form map (``COLUMN, VALUE`` and
    ``payload``); the results are added under ``names``. Null values match nothing.

    The HOT_CELLS most frequent values of all columns together, known to the map or
    not, are found in one pass (or in ``counts``) and matched by broadcasts of as many
    rows; no row moves for them. The other cells meet the map in one shuffle join and
    go back to their rows by row number, TASK_CELLS a task. The table is written once in between, so the
    plan and the number of scans do not depend on the number of columns but for a
    broadcast join each."""
    spark, last = df.sparkSession, len(values) - 1
    most = (cell_counts(df, values) if counts is None else counts).orderBy(F.desc(COUNT), COLUMN, VALUE).limit(HOT_CELLS)
    known = table.select(COLUMN, VALUE, F.col(payload).alias("__p"))
    hot = most.select(COLUMN, VALUE).join(known, [COLUMN, VALUE], "left")
    rows = hot.collect()  # HOT_CELLS rows at most
    wide = df.select("*", *[v.alias(f"__cell{i}") for i, v in enumerate(values)])
    for i in range(last + 1):
        own = spark.createDataFrame([r for r in rows if r[COLUMN] == i], hot.schema).select(
            F.col(VALUE).alias(f"__key{i}"), F.col("__p").alias(f"__hot{i}"))
        wide = wide.join(F.broadcast(own), F.col(f"__cell{i}") == F.col(f"__key{i}"), "left")
    wide = materialize(wide.select(*[col(c) for c in df.columns], F.monotonically_increasing_id().alias(ROW), *[x for i in range(
        last + 1) for x in (F.when(F.col(f"__key{i}").isNull(), F.col(f"__cell{i}")).alias(f"__cell{i}"), F.col(f"__hot{i}"))]), "lookup")
    left = [F.col(f"__cell{i}") for i in range(last + 1)]
    n = sum(wide.agg(*[F.count(c) for c in left]).first())
    tasks = max(-(-n // TASK_CELLS), spark.sparkContext.defaultParallelism)
    met = cells(wide, left, ROW).repartition(tasks, COLUMN, VALUE).join(known.repartition(tasks, COLUMN, VALUE), [COLUMN, VALUE])
    found = met.select(ROW, COLUMN, "__p").repartition(tasks, ROW).groupBy(F.col(ROW).alias("__of")).agg(
        *[F.first(F.when(F.col(COLUMN) == i, F.col("__p")), ignorenulls=True).alias(f"__got{i}") for i in range(last + 1)])
    open_ = F.coalesce(*[c.cast("string") for c in left]).isNotNull()
    kept = [col(c) for c in df.columns]
    done = wide.where(~open_).select(*kept, *[F.col(f"__hot{i}").alias(n) for i, n in enumerate(names)])
    rest = wide.where(open_).repartition(tasks, ROW).join(found, F.col(ROW) == F.col("__of"), "left").select(
        *kept, *[F.coalesce(f"__got{i}", f"__hot{i}").alias(n) for i, n in enumerate(names)])
    return done.unionByName(rest)
