"""One-dimensional k-means by exact cuts instead of iterated guesses.

Clusters of numbers are stretches of their order, so the best ones follow from
dynamic programming over sorted values with counts. Up to ``MOST_VALUES`` distinct
values are taken one by one and the cuts are the best there are. Beyond that the
values are summed up in cells of about equal counts, the cuts run along borders of
cells, and the cells beside a cut and those that spread most are divided until every
cut stands between two single values. The driver sees sums of cells only, and
nothing depends on a seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from sparktidy.plans.quantiles import as_splits, cut_values

MOST_VALUES = 4096
PIECES = 32  # a cell is divided into so many
WIDEST = 32  # so many cells of large spread are divided at a time
ROUNDS = 40


def best_cuts(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> list[int]:
    """Starts of the 2nd to k-th cluster of ordered cells with counts, sums and
    sums of squares. The best start of a last cluster never moves left as more
    cells are added, which halves the search at every step."""
    counts, sums, squares = (np.concatenate([[0.0], np.cumsum(part, dtype=np.float64)]) for part in (n, s, q))
    size = len(n)

    def spread(first, last):
        total = sums[last] - sums[first]
        return squares[last] - squares[first] - total * total / (counts[last] - counts[first])

    cost = np.concatenate([[0.0], spread(np.zeros(size, int), np.arange(1, size + 1))])
    starts = []
    for used in range(1, k):
        longer, start = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        todo = [(used + 1, size, used, size - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            options = np.arange(left, min(right, middle - 1) + 1)
            found = cost[options] + spread(options, middle)
            at = int(found.argmin())
            longer[middle], start[middle] = found[at], options[at]
            todo += [(low, middle - 1, left, int(options[at])), (middle + 1, high, int(options[at]), right)]
        cost = longer
        starts.append(start)
    cuts, end = [], size
    for start in reversed(starts):
        end = int(start[end])
        cuts.append(end)
    return cuts[::-1]


def _means(n, s, cuts, centre) -> list[float]:
    edges = [0, *cuts, len(n)]
    return [float(s[a:b].sum() / n[a:b].sum() + centre) for a, b in zip(edges, edges[1:])]


def cluster_means(values: DataFrame, k: int, most_values: int = MOST_VALUES) -> list[float]:
    """Means of the k clusters of the column ``v``, in order; fewer if there are
    fewer distinct values, none if there is no finite one."""
    data = values.where("v IS NOT NULL AND abs(v) < double('Infinity')").select((F.col("v") + 0.0).alias("v"))
    distinct, centre = data.agg(F.approx_count_distinct("v", 0.02), F.avg("v")).first()
    if not distinct:
        return []
    if distinct <= most_values:
        found = sorted((r["v"], r["n"]) for r in data.groupBy("v").agg(F.count("*").alias("n")).collect())
        v, n = np.array([f[0] for f in found]) - centre, np.array([f[1] for f in found], np.float64)
        return _means(n, n * v, best_cuts(n, n * v, n * v * v, min(k, len(n))), centre)
    _, cuts = cut_values(data, {"v": F.col("v")}, most_values)
    borders = set(cuts["v"])
    away = F.col("v") - F.lit(centre)
    for _ in range(ROUNDS):
        placed = Bucketizer(splits=as_splits(borders), inputCol="v", outputCol="cell").transform(data)
        rows = sorted(placed.groupBy("cell").agg(
            F.count("*"), F.sum(away), F.sum(away * away), F.min("v"), F.max("v")).collect())
        n, s, q, low, high = (np.array([r[i] for r in rows], np.float64) for i in range(1, 6))
        starts = best_cuts(n, s, q, min(k, len(n)))
        inner = np.where(low < high, q - s * s / n, 0.0)
        edges = [0, *starts, len(n)]
        whole = sum(q[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:]))
        widest = [i for i in np.argsort(-inner)[:WIDEST] if inner[i] * MOST_VALUES > whole]
        beside = {i for start in starts for i in (start - 1, start)}
        divide = [i for i in beside.union(widest) if low[i] < high[i]]
        if not divide:
            break
        for i in divide:
            borders.update(np.linspace(low[i], high[i], PIECES + 1)[1:].tolist())
    return _means(n, s, starts, centre)
