"""Mutual information of two numbers from nearest neighbours.

For every point the distance r to its k-th neighbour is found in the plane, the
larger of both differences counting, after both columns are divided by their
standard deviation. With a and b the points whose x, or y, lies nearer than r (the
point itself included), the estimate in nats is
``psi(N) + mean(psi(k) - psi(a) - psi(b))``, 0 at least. Where more than k other points
equal a point, r is 0: then k is their number, and a and b count equal values.

Equal points are one weighted point. Points lie in cells of about equal counts, cut
along x and then along y of each slice, so a value that many rows share is spread over
cells by the other column. A cell gives each of its points a bound; only points whose
square reaches beyond the cell ask the cells it meets, and only for what is nearer than
the bound. Counts along an axis come from running sums over sorted values and the
borders of all intervals. Cuts come from a bounded hash sample and change no result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.plans.ordering import running_total
from sparktidy.plans.sampling import hash_limit, key_bits
from sparktidy.session import materialize

NEIGHBOURS = 3
CELL_POINTS, SAMPLE, MAX_CELLS = 10_000, 200_000, 20_000
PAIRS = 1 << 20  # pairs compared at once
POINT = "f int, x double, y double"


def digamma(n: Column) -> Column:
    """psi of a number from 1 on: eight steps up, then the asymptotic series."""
    z = n.cast("double") + 8
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6))
    return series - sum((1 / (n + i) for i in range(1, 8)), 1 / n.cast("double"))


@dataclass
class Grid:
    """Cuts along x, and per slice cuts along y; cells are numbered slice by slice."""

    x: np.ndarray
    y: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, cells: int) -> Grid:
        slices = max(1, int(math.sqrt(cells)))
        cuts = np.unique(np.quantile(x, np.arange(1, slices) / slices)) if len(x) and slices > 1 else np.empty(0)
        cuts = np.unique(np.concatenate([cuts, np.nextafter(cuts, np.inf)]))
        place, inner = np.searchsorted(cuts, x, "right"), []
        for i in range(len(cuts) + 1):
            own = y[place == i]
            parts = round(len(own) * cells / max(len(x), 1))
            inner.append(np.unique(np.quantile(own, np.arange(1, parts) / parts)) if parts > 1 else np.empty(0))
        return cls(cuts, inner)

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.y])])

    def cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place, out = np.searchsorted(self.x, x, "right"), np.zeros(len(x), np.int64)
        first = self.first
        for i in np.unique(place):
            own = place == i
            out[own] = first[i] + np.searchsorted(self.y[i], y[own], "right")
        return out

    def reached(self, x, y, r) -> tuple[np.ndarray, np.ndarray]:
        """Point and cell for every cell that a point's square meets."""
        low, high = np.searchsorted(self.x, x - r, "right"), np.searchsorted(self.x, x + r, "right")
        point, slices = _spread(low, high - low + 1)
        first, points, cells = self.first, [], []
        for i in np.unique(slices):
            own = point[slices == i]
            bottom, top = (np.searchsorted(self.y[i], v, "right") for v in (y[own] - r[own], y[own] + r[own]))
            which, at = _spread(bottom, top - bottom + 1)
            points.append(own[which])
            cells.append(first[i] + at)
        return (np.concatenate(points), np.concatenate(cells)) if points else (point, slices)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and ``start .. start + count - 1`` for every row."""
    row = np.repeat(np.arange(len(start)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _insert(best: np.ndarray, rows: np.ndarray, far: np.ndarray, copies: np.ndarray) -> None:
    """Take ``copies`` times the distance ``far`` into the sorted nearest of ``rows``."""
    for c in range(best.shape[1]):
        use = (copies > c) & (far < best[rows, -1])
        if not use.any():
            break
        at = rows[use]
        best[at] = np.sort(np.column_stack([best[at], far[use]]), axis=1)[:, :-1]


def _within(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Distances to the k nearest within a cell, infinite where there are fewer."""
    by_y = len(np.unique(y)) > len(np.unique(x))
    order = np.argsort(y if by_y else x, kind="stable")
    a, b, w = (y if by_y else x)[order], (x if by_y else y)[order], w[order]
    best = np.full((len(a), k), np.inf)
    for c in range(k):
        best[w - 1 > c, c] = 0.0
    for gap in range(1, len(a)):
        along = a[gap:] - a[:-gap]
        limit = np.maximum(best[gap:, -1], best[:-gap, -1])
        left = np.flatnonzero(along < limit)
        if not len(left):
            break
        far = np.maximum(along[left], np.abs(b[left + gap] - b[left]))
        _insert(best, left, far, w[left + gap])
        _insert(best, left + gap, far, w[left])
    out = np.empty_like(best)
    out[order] = best
    return out


def _asked(points: pd.DataFrame, probes: pd.DataFrame, k: int) -> np.ndarray:
    """Distances from probes to the k nearest of a cell's points, nearer than their bound."""
    px, py, w = (points[c].to_numpy() for c in ("x", "y", "w"))
    order = np.argsort(px, kind="stable")
    px, py, w = px[order], py[order], w[order]
    x, y, r = (probes[c].to_numpy() for c in ("x", "y", "r"))
    start, end = np.searchsorted(px, x - r, "left"), np.searchsorted(px, x + r, "right")
    best = np.full((len(x), k), np.inf)
    done = np.zeros(len(x), np.int64)
    while True:  # every probe's strip in pieces, so that memory stays bounded
        open_rows = np.flatnonzero(start + done < end)
        if not len(open_rows):
            break
        piece = max(1, PAIRS // len(open_rows))
        count = np.minimum(end[open_rows] - start[open_rows] - done[open_rows], piece)
        which, at = _spread(start[open_rows] + done[open_rows], count)
        row = open_rows[which]
        far = np.maximum(np.abs(px[at] - x[row]), np.abs(py[at] - y[row]))
        near = far < np.minimum(r, best[:, -1])[row]
        row, far, copies = row[near], far[near], w[at[near]]
        by = np.lexsort((far, row))
        row, far, copies = row[by], far[by], copies[by]
        turns = np.arange(len(row)) - np.searchsorted(row, row, "left")
        for turn in range(k):  # a row's nearest k of this piece, one at a time
            now = turns == turn
            _insert(best, row[now], far[now], copies[now])
        done[open_rows] += count
    return best


def _lists(rows: np.ndarray, part: pd.DataFrame) -> pd.Series:
    return pd.Series(list(rows), index=part.index, dtype=object)


def neighbour_information(df: DataFrame, target: str, features: list[str], k: int = NEIGHBOURS,
                          cell_points: int = CELL_POINTS) -> DataFrame:
    """``feature, score`` for numeric features and a numeric target. Rows with a null
    or NaN in any of them are left out; infinite values count as such rows. Null where
    fewer than two rows are left."""
    names = [target, *features]
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    for c in clean.columns:
        clean = clean.where(F.abs(c) < float("inf"))
    # a constant column may have a deviation of some last bits
    facts = clean.agg(F.count("*"), *[F.when(F.min(c) < F.max(c), F.stddev_pop(c)) for c in clean.columns]).first()
    rows, spreads = facts[0], [s or 1.0 for s in facts[1:]]
    spark = df.sparkSession
    if rows < 2:
        return spark.createDataFrame([(f, None) for f in features], "feature string, score double")
    k = min(k, rows - 1)
    scaled = [F.col(c) / F.lit(s) + 0.0 for c, s in zip(clean.columns, spreads)]
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), x.alias("x"), scaled[0].alias("y")) for i, x in enumerate(scaled[1:])])
    points = materialize(clean.select(F.inline(pairs)).groupBy("f", "x", "y").agg(F.count("*").alias("w")), "points")
    sizes = {r["f"]: r["count"] for r in points.groupBy("f").count().collect()}
    keys = [F.col("x"), F.col("y")]
    sample = points.where(key_bits(keys, "cells") < F.lit(hash_limit(max(sizes.values()), SAMPLE // len(features))))
    drawn = sample.select("f", "x", "y").toPandas()
    grids = {}
    for i in sizes:
        own = drawn[drawn["f"] == i]
        grids[i] = Grid.of(own["x"].to_numpy(), own["y"].to_numpy(), min(max(sizes[i] // cell_points, 1), MAX_CELLS))
    shared = spark.sparkContext.broadcast(grids)

    def place(batches):
        for part in batches:
            cell = np.zeros(len(part), np.int64)
            for i in part["f"].unique():
                own = (part["f"] == i).to_numpy()
                cell[own] = shared.value[i].cell(part["x"].to_numpy()[own], part["y"].to_numpy()[own])
            yield part.assign(cell=cell)

    def bound(part):
        near = _within(part["x"].to_numpy(), part["y"].to_numpy(), part["w"].to_numpy(), k)
        return part.assign(near=_lists(near, part))

    def reach(batches):
        for part in batches:
            for i in part["f"].unique():
                own = part[part["f"] == i]
                x, y, r = (own[c].to_numpy() for c in ("x", "y", "r"))
                point, cell = shared.value[i].reached(x, y, r)
                other = cell != own["cell"].to_numpy()[point]
                point, cell = point[other], cell[other]
                for at in range(0, len(point), 1 << 16):
                    p = point[at: at + (1 << 16)]
                    yield pd.DataFrame({"f": np.full(len(p), i, np.int32), "x": x[p], "y": y[p], "r": r[p],
                                        "cell": cell[at: at + (1 << 16)]})

    def ask(mine, probes):
        if not len(mine):
            probes = probes[:0]
        return probes[["f", "x", "y"]].assign(near=_lists(_asked(mine, probes, k), probes))

    placed = materialize(points.mapInPandas(place, f"{POINT}, w long, cell long"), "cells")
    inside = materialize(placed.groupBy("f", "cell").applyInPandas(
        bound, f"{POINT}, w long, cell long, near array<double>"), "bounds")
    crossing = inside.select("f", "x", "y", "cell", F.element_at("near", k).alias("r")).where("r > 0")
    probes = crossing.mapInPandas(reach, f"{POINT}, r double, cell long")
    found = placed.groupBy("f", "cell").cogroup(probes.groupBy("f", "cell")).applyInPandas(
        ask, f"{POINT}, near array<double>")
    nearer = found.select("f", "x", "y", F.lit(None).cast("long").alias("w"),
                          F.filter("near", lambda d: d < float("inf")).alias("near")).where(F.size("near") > 0)
    both = inside.select("f", "x", "y", "w", "near").unionByName(nearer)
    every = F.flatten(F.collect_list("near"))
    radius = materialize(both.groupBy("f", "x", "y").agg(
        F.max("w").alias("w"), F.element_at(F.array_sort(every), k).alias("r")), "radii")
    return _scores(radius, rows, k, features)


def _scores(radius: DataFrame, rows: int, k: int, features: list[str]) -> DataFrame:
    """Counts along both axes and the mean over all points."""
    r, w = F.col("r"), F.col("w")

    def side(name: str, sign: int) -> Column:
        # equal within rounding is not nearer
        slack = r * 1e-10 + F.abs(F.col(name)) * 1e-15
        return F.when(r > 0, F.col(name) + sign * (r - slack)).otherwise(F.col(name))

    marks = [F.struct(F.lit(a).alias("axis"), v.alias("v"), F.lit(kind).alias("kind"), n.cast("long").alias("n"))
             for a in ("x", "y") for v, kind, n in ((side(a, -1), 0, F.lit(0)), (F.col(a), 1, w), (side(a, 1), 2, F.lit(0)))]
    events = radius.select("f", "x", "y", F.inline(F.array(*marks)))
    totals = running_total(events, F.col("n"), ["f", "axis", "v", "kind"], "upto", ["f", "axis"])
    signed = F.when(F.col("kind") == 2, F.col("upto")).when(F.col("kind") == 0, -F.col("upto"))
    counts = totals.groupBy("f", "x", "y").agg(*[
        F.sum(F.when(F.col("axis") == a, signed)).alias(f"n{a}") for a in ("x", "y")])
    known = radius.join(counts, ["f", "x", "y"])
    kth = F.when(r > 0, F.lit(k)).otherwise(w - 1)
    mean = F.sum(w * (digamma(kth) - digamma(F.col("nx")) - digamma(F.col("ny")))) / rows
    names = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    return known.groupBy("f").agg(F.greatest(F.lit(0.0), digamma(F.lit(rows)) + mean).alias("score")).select(
        names.alias("feature"), "score")
