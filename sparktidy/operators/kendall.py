"""Kendall tau-b without comparing all pairs of rows.

Distinct (x, y) pairs with counts are laid on a grid of equal-frequency bands.
Pairs of points in different columns and different rows of the grid follow from
prefix sums over the bounded grid. Points sharing a column, or sharing a row but
not a column, are compared inside one band by a sorted count that costs
m log m for m points. A value frequent enough to fill a band has a band of its
own, and there nothing is left to compare because all its points tie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from sparktidy.functions.exprs import col
from sparktidy.plans.quantiles import as_splits, cut_values

BAND_POINTS = 200_000
MIN_BANDS, MAX_BANDS = 16, 8192


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Concordant minus discordant weight over pairs with both values different.
    Works down the bits of the rank of y: at each bit, pairs that agree on all
    higher bits are told apart by this one."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order].astype("float64")
    rank = np.unique(y[order], return_inverse=True)[1]
    total = 0.0
    for bit in range(max(int(rank.max()).bit_length(), 1) if len(rank) else 0):
        block = rank >> (bit + 1)
        by = np.lexsort((x, block))
        b, xs, ws = block[by], x[by], w[by]
        one = (rank[by] >> bit) & 1
        new_block = np.r_[True, b[1:] != b[:-1]]
        new_x = new_block | np.r_[True, xs[1:] != xs[:-1]]
        ones = np.r_[0.0, np.cumsum(ws * one)]
        zeros = np.r_[0.0, np.cumsum(ws * (1 - one))]
        start_block = np.maximum.accumulate(np.where(new_block, np.arange(len(b)), 0))
        start_x = np.maximum.accumulate(np.where(new_x, np.arange(len(b)), 0))
        ones_left = ones[start_x] - ones[start_block]
        zeros_left = zeros[start_x] - zeros[start_block]
        total += float(np.sum(ws * np.where(one == 1, zeros_left, -ones_left)))
    return total


def _within_x_band(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"amount": [_signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})


def _within_y_band(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"amount": [_signed_pairs(pdf["xb"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})


def _banded(points: DataFrame, bands: int) -> DataFrame:
    _, cuts = cut_values(points, {s: F.col(s) for s in ("x", "y")}, bands)
    for side in ("x", "y"):
        inner = set(cuts[side])
        # A repeated cut is a frequent value: a second cut just above fences it in.
        inner |= {float(np.nextafter(v, np.inf)) for v in inner}
        points = Bucketizer(splits=as_splits(inner), inputCol=side, outputCol=f"{side}b", handleInvalid="keep").transform(points)
        points = points.withColumn(f"{side}b", F.col(f"{side}b").cast("int"))
    return points


def _cross_band(points: DataFrame, bands: int) -> DataFrame:
    """Pairs in different x bands and different y bands, from the dense grid."""
    side = 2 * bands + 2
    spark = points.sparkSession
    cells = points.groupBy("xb", "yb").agg(F.sum("w").alias("w"))
    frame = spark.range(side * side).select(
        (F.col("id") / side).cast("int").alias("xb"), (F.col("id") % side).cast("int").alias("yb"))
    grid = frame.join(cells, ["xb", "yb"], "left").select("xb", "yb", F.coalesce("w", F.lit(0)).alias("w"))
    below = Window.partitionBy("xb").orderBy("yb").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("xb").orderBy("yb").rowsBetween(1, Window.unboundedFollowing)
    left = Window.partitionBy("yb").orderBy("xb").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = grid.select("xb", "yb", "w", F.coalesce(F.sum("w").over(below), zero).alias("lo"),
                       F.coalesce(F.sum("w").over(above), zero).alias("hi"))
    signed = sums.select("w", F.coalesce(F.sum(F.col("lo") - F.col("hi")).over(left), zero).alias("net"))
    return signed.agg(F.sum(F.col("w").cast("double") * F.col("net")).alias("amount"))


def _band_count(both: DataFrame) -> int:
    """Bands grow with the number of distinct points, so one band stays a task's
    work; the grid of bands stays bounded."""
    points = both.agg(F.approx_count_distinct(F.xxhash64("x", "y"))).first()[0]
    return min(max(points // BAND_POINTS, MIN_BANDS), MAX_BANDS)


def kendall_pair(df: DataFrame, a: str, b: str, bands: int | None = None) -> DataFrame:
    """One row with ``correlation``: tau-b over rows where both are present."""
    both = df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")).na.drop()
    bands = bands or _band_count(both)
    points = _banded(both.groupBy("x", "y").agg(F.count("*").alias("w")), bands)
    spread = {s: points.groupBy(f"{s}b").agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
              .where(F.col("lo") < F.col("hi")).select(f"{s}b") for s in ("x", "y")}

    def ties(*keys):
        n = F.col("n").cast("double")
        return points.groupBy(*keys).agg(F.sum("w").alias("n")).agg(F.sum(n * (n - 1) / 2).alias("amount"))

    within = [
        points.join(F.broadcast(spread[s]), f"{s}b", "left_semi").groupBy(f"{s}b")
        .applyInPandas(compare, "amount double")
        for s, compare in (("x", _within_x_band), ("y", _within_y_band))]
    tagged = [("score", _cross_band(points, bands)), ("score", within[0]), ("score", within[1]),
              ("all", ties()), ("x", ties("x")), ("y", ties("y"))]
    parts = None
    for kind, part in tagged:
        part = part.select(F.lit(kind).alias("kind"), "amount")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.agg(*[F.sum(F.when(F.col("kind") == k, F.col("amount"))).alias(k) for k in ("score", "all", "x", "y")])
    free_x, free_y = F.col("all") - F.col("x"), F.col("all") - F.col("y")
    return sums.select(F.try_divide(F.col("score"), F.sqrt(free_x) * F.sqrt(free_y)).alias("correlation"))
