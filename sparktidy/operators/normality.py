"""Normality tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sparktidy.config import get_config
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.functions.normal import inverse_normal, upper_tail
from sparktidy.plans.shape import rows_from
from sparktidy.plans.sampling import BITS, key_bits

SAMPLE_LIMIT = 5000

# Polynomial coefficients of Royston's AS R94, lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_STD = [1.3822, -0.77857, 0.062767, -0.0020322]
SMALL_BOUND = [-2.273, 0.459]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_STD = [-0.4803, -0.082676, 0.0030302]


def _poly(coefficients: list[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p-value for 3 to 5000 values (Royston 1995)."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    spread = float(np.sum((x - x.mean()) ** 2))
    if spread == 0.0:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = inverse_normal((np.arange(1, n + 1) - 0.375) / (n + 0.25))
        length = float(m @ m)
        u = 1.0 / math.sqrt(n)
        tail = [m[-1] / math.sqrt(length) + _poly(LAST_WEIGHT, u)]
        if n > 5:
            tail.insert(0, m[-2] / math.sqrt(length) + _poly(NEXT_WEIGHT, u))
        e = len(tail)
        rest = (length - 2 * float(m[-e:] @ m[-e:])) / (1 - 2 * sum(t * t for t in tail))
        a = m / math.sqrt(rest)
        a[-e:] = tail
        a[:e] = -np.array(tail)[::-1]
    w = min(float(a @ x) ** 2 / spread, 1.0)
    if n == 3:
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    y = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        bound = _poly(SMALL_BOUND, n)
        if y >= bound:
            return w, 0.0
        y, mean, log_std = -math.log(bound - y), _poly(SMALL_MEAN, n), _poly(SMALL_LOG_STD, n)
    else:
        mean, log_std = _poly(LARGE_MEAN, math.log(n)), _poly(LARGE_LOG_STD, math.log(n))
    return w, upper_tail((y - mean) / math.exp(log_std))


def shapiro_test(
    df: DataFrame, columns: list[str] | None = None, alpha: float = 0.05, seed: int | None = None,
    most: int = SAMPLE_LIMIT,
) -> DataFrame:
    """Shapiro-Wilk per column; ``n`` values tested of ``n_total``.

    The test is defined for up to 5000 values, ``most``. Longer columns are
    sampled by value counts: a value that holds a share of the rows gets that
    share of the sample, the rest of it decided by a seeded hash of the value. So
    the draw repeats, needs no key, and repeated rows are no trouble.
    """
    columns = columns or kinds.numeric_columns(df)
    seed = get_config().random_state if seed is None else seed
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).where("value IS NOT NULL AND NOT isnan(value)").groupBy("column", "value").agg(
        F.count("*").alias("copies"))
    totals = counts.groupBy("column").agg(F.sum("copies").alias("n_total"))
    wanted = F.when(F.col("n_total") <= most, F.col("copies").cast("double")).otherwise(
        F.col("copies") * (most - 4 * math.sqrt(most)) / F.col("n_total"))
    unit = key_bits([F.col("column"), F.col("value")], seed) / float(2**BITS)
    drawn = counts.join(F.broadcast(totals), "column").withColumn("times", F.floor(wanted + unit).cast("int"))
    drawn = drawn.withColumn("times", F.when(F.col("n_total") <= most, F.col("copies").cast("int")).otherwise(F.col("times")))
    pick = key_bits([F.col("column"), F.col("value")], seed, "order")
    sample = drawn.where("times > 0").select("column", "value", "n_total", pick.alias("pick"),
                                             F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    order = Window.partitionBy("column").orderBy("pick", "value", "copy")
    sample = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        w, p = shapiro_wilk(pdf["value"].to_numpy()) if n >= 3 else (None, None)
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n": [n], "n_total": [pdf["n_total"].iloc[0]], "statistic": [w], "p_value": [p],
                             "is_normal": [None if p is None else bool(p > alpha)]})

    return sample.groupBy("column").applyInPandas(
        test, "column string, n long, n_total long, statistic double, p_value double, is_normal boolean")


def jarque_bera(df: DataFrame, columns: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera over all rows, from moments alone: the test that scales."""
    columns = columns or kinds.numeric_columns(df)
    wide = df.agg(*[fn(col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate(columns)
                    for name, fn in (("n", F.count), ("s", F.skewness), ("k", F.kurtosis))])
    records = []
    for i, c in enumerate(columns):
        n, s, k = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"k{i}")
        jb = n / 6.0 * (s * s + k * k / 4.0)
        p = F.exp(-jb / 2.0)
        records.append({"column": F.lit(c), "n": n, "statistic": jb, "p_value": p, "is_normal": p > alpha})
    return rows_from(wide, records)
