"""Exact k-nearest-neighbour imputation as a two-round distributed join.

Rows with a value (donors) are cut into cells by a tree of cuts along the locally
widest column; every cell knows its box, and the box of a cell bounds its distance
from below, whichever columns a row lacks. Round one compares each row that needs a
value with the cell nearest to it, which bounds its k-th distance. Round two visits
only the cells that the bound cannot rule out. Rows that lack the widest column use
a tree of their own over the columns they have, and so on. Cells and groups of
queries are both split when large, so no task holds an unbounded group, and each
task emits k candidates per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.errors import DataValidationError
from sparktidy.functions import types as kinds
from sparktidy.functions.exprs import col
from sparktidy.plans.sampling import hash_limit, key_bits
from sparktidy.session import materialize

CELL_ROWS = 20_000
MAX_CELLS = 4096
# Donors that place the cuts of a tree. All donors are indexed, and boxes are taken from all of them.
SAMPLE_ROWS = 200_000
# Queries compared at a time, and donors on each side that give a first bound.
BLOCK, WINDOW = 64, 64


@dataclass(frozen=True)
class Tree:
    """Nodes with one cut each. A child is a node's number, or ``~c`` for cell c."""

    root: int
    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    absent: np.ndarray
    cells: int

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point; missing values (NaN) have their own way."""
        at = np.full(len(points), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            value = points[inner, self.axis[node]]
            side = np.where(value < self.cut[node], self.below[node], self.above[node])
            at[inner] = np.where(np.isnan(value), self.absent[node], side)
        return ~at


def grow(points: np.ndarray, axes: list[int], cells: int) -> Tree:
    """About ``cells`` cells of similar size, cut along the axis that varies most
    within its node. Points that share all values stay together."""
    nodes: list[list] = []
    leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return ~(leaves - 1)

    def spread(values: np.ndarray) -> float:
        present = values[~np.isnan(values)]
        return present.var() * len(present) / len(values) if len(present) and present.min() < present.max() else 0.0

    def node(rows: np.ndarray, quota: int) -> int:
        spreads = [spread(points[rows, a]) for a in axes] if quota > 1 else []
        if not spreads or max(spreads) <= 0:
            return leaf()
        axis = axes[int(np.argmax(spreads))]
        values = points[rows, axis]
        missing = np.isnan(values)
        low, cut = np.nanmin(values), np.median(values[~missing])
        cut = cut if cut > low else values[values > low].min()
        own = len(nodes)
        nodes.append([axis, cut])

        def child(part: np.ndarray) -> int:
            return node(rows[part], max(1, round(quota * part.sum() / len(rows))))

        below = child(values < cut)
        nodes[own] += [below, child(values >= cut), child(missing) if missing.any() else below]
        return own

    root = node(np.arange(len(points)), cells) if len(points) else leaf()
    columns = list(zip(*nodes)) or [()] * 5
    kinds_of = (int, float, int, int, int)
    return Tree(root, *[np.array(c, dtype=t) for c, t in zip(columns, kinds_of)], cells=leaves)


@dataclass(frozen=True)
class Boxes:
    """Per cell: number of donors, smallest and largest value of every feature,
    whether all donors have it and whether any has."""

    cell: np.ndarray
    tree: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sure: np.ndarray
    some: np.ndarray

    def bounds(self, queries: np.ndarray, width: int) -> np.ndarray:
        """For each query and cell a distance that no donor of the cell falls
        below: gaps count where every donor has the column, scaled as if the donor
        had all columns that the query has. Infinite where none is shared."""
        total = np.zeros((len(queries), len(self.cell)))
        shared = np.zeros(total.shape)
        for j in range(queries.shape[1]):
            q = queries[:, j, None]
            present = ~np.isnan(q)
            gap = np.maximum(np.maximum(self.low[None, :, j] - q, q - self.high[None, :, j]), 0.0)
            total += np.where(present & self.sure[None, :, j], gap * gap, 0.0)
            shared += present & self.some[None, :, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, total * (width / shared), np.inf)

    def nearest(self, tree: np.ndarray, queries: np.ndarray, width: int, k: int) -> list[list[int]]:
        """The cells to look at first: by their bounds, then by their centres,
        until they hold k donors."""
        middle = np.where(self.some, (self.low + self.high) / 2, np.nan)
        out = []
        for at in range(0, len(queries), BLOCK):
            q = queries[at:at + BLOCK]
            bound = np.where(tree[at:at + BLOCK, None] == self.tree[None, :], self.bounds(q, width), np.inf)
            centre = _distances(q, middle, width)
            for i in range(len(q)):
                order = np.lexsort((centre[i], bound[i]))
                order = order[np.isfinite(bound[i][order])]
                enough = int(np.searchsorted(np.cumsum(self.rows[order]), k)) + 1
                out.append(self.cell[order[:enough]].tolist())
        return out

    def within(self, tree: np.ndarray, queries: np.ndarray, width: int, edge: np.ndarray) -> list[np.ndarray]:
        """The cells that may hold a donor at the distance ``edge`` or nearer."""
        out = []
        for at in range(0, len(queries), BLOCK):
            bound = self.bounds(queries[at:at + BLOCK], width)
            near = (tree[at:at + BLOCK, None] == self.tree[None, :]) & (bound <= edge[at:at + BLOCK, None]) & np.isfinite(bound)
            out += [self.cell[row] for row in near]
        return out


def _distances(q: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """Squared distances, scaled up by the share of columns both rows have."""
    total = np.zeros((len(q), len(d)))
    shared = np.zeros((len(q), len(d)))
    for j in range(q.shape[1]):
        gap = q[:, j, None] - d[None, :, j]
        present = ~np.isnan(gap)
        total += np.where(present, gap * gap, 0.0)
        shared += present
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * (width / shared), np.inf)


def _edge(scaled: np.ndarray, k: int) -> np.ndarray:
    """Distance of the k-th nearest donor, infinite when there are fewer."""
    if scaled.shape[1] < k:
        return np.full(len(scaled), np.inf)
    return np.partition(scaled, k - 1, axis=1)[:, k - 1]


def _widest(donors: np.ndarray, queries: np.ndarray) -> int | None:
    """The column that varies most among those that all donors have; one that
    all queries have as well comes first."""
    full = ~np.isnan(donors).any(axis=0)
    best = [j for j in np.flatnonzero(full) if not np.isnan(queries[:, j]).any()] or np.flatnonzero(full).tolist()
    return max(best, key=lambda j: donors[:, j].var(), default=None)


def _nearest(k: int, width: int, features: list[str], known: list[str], key: list[str]):
    """Per-task search: k best donors per query by (distance, donor key). Donors
    lie sorted by the pivot, their widest column; the nearest few along it bound
    the distance, and only donors within the bound are compared."""

    def search(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        columns = [*[f"q_{c}" for c in key], *[f"d_{c}" for c in key], "dist", "y"]
        if queries.empty or donors.empty:
            return pd.DataFrame(columns=columns)
        donors = donors.sort_values([f"d_{c}" for c in key], kind="stable").reset_index(drop=True)
        pivot = _widest(donors[known].to_numpy("float64"), queries[features].to_numpy("float64"))
        if pivot is not None:
            donors = donors.sort_values(known[pivot], kind="stable")
            queries = queries.sort_values(features[pivot], kind="stable")
        rank = donors.index.to_numpy()
        d, q = donors[known].to_numpy("float64"), queries[features].to_numpy("float64")
        q_at, d_at, dist = [], [], []
        for start in range(0, len(q), BLOCK):
            block = q[start:start + BLOCK]
            first, last = 0, len(d)
            if pivot is not None and not np.isnan(block[:, pivot]).any():
                axis, low, high = d[:, pivot], block[0, pivot], block[-1, pivot]
                near = slice(max(int(np.searchsorted(axis, low)) - WINDOW, 0), int(np.searchsorted(axis, high, "right")) + WINDOW)
                seen = (~np.isnan(block)).sum(axis=1)
                reach = np.sqrt(_edge(_distances(block, d[near], width), k) * seen / width).max() * (1 + 1e-9)
                first = int(np.searchsorted(axis, low - reach))
                last = int(np.searchsorted(axis, high + reach, "right"))
            scaled = _distances(block, d[first:last], width)
            edge = _edge(scaled, min(k, last - first))
            for i in range(len(block)):
                near_i = np.flatnonzero((scaled[i] <= edge[i]) & np.isfinite(scaled[i]))
                near_i = near_i[np.lexsort((rank[first + near_i], scaled[i][near_i]))][:k]
                q_at += [start + i] * len(near_i)
                d_at += (first + near_i).tolist()
                dist += scaled[i][near_i].tolist()
        left = queries[[f"q_{c}" for c in key]].iloc[q_at].reset_index(drop=True)
        right = donors[[f"d_{c}" for c in key] + ["y"]].iloc[d_at].reset_index(drop=True)
        return pd.concat([left, right], axis=1).assign(dist=dist)[columns]

    return search


def _top(candidates: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*[f"q_{c}" for c in key]).orderBy("dist", *[f"d_{c}" for c in key])
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _search(visits: DataFrame, donors: DataFrame, slices, search, schema: str, key, features, known) -> DataFrame:
    """Compare every (query, cell) visit with the donors of the cell. A cell's
    donors are split into slices that each visit sees; many visits to one cell
    are split into chunks that each see all slices."""
    spark = donors.sparkSession
    busy = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(c, slices[c], math.ceil(n / CELL_ROWS)) for c, n in busy.items() if c in slices],
        "cell int, slices int, chunks int")
    plan = F.broadcast(plan)
    q = (visits.join(plan, "cell")
         .withColumn("chunk", F.pmod(F.xxhash64(*[f"q_{c}" for c in key]), F.col("chunks")).cast("int"))
         .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
         .select("cell", "slice", "chunk", *[f"q_{c}" for c in key], *features))
    d = (donors.join(plan, "cell")
         .withColumn("slice", F.pmod(F.xxhash64(*[f"d_{c}" for c in key]), F.col("slices")).cast("int"))
         .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
         .select("cell", "slice", "chunk", *[f"d_{c}" for c in key], "y", *known))
    unit = ["cell", "slice", "chunk"]
    return q.groupBy(*unit).cogroup(d.groupBy(*unit)).applyInPandas(search, schema)


def _frame(columns: tuple[pd.Series, ...]) -> np.ndarray:
    return np.column_stack([c.to_numpy("float64", na_value=np.nan) for c in columns])


def _cells_of(trees: list[Tree], offsets: list[int]):
    """The cell of a donor in every tree."""

    @F.pandas_udf("array<int>")
    def cells(*columns: pd.Series) -> pd.Series:
        points = _frame(columns)
        found = np.column_stack([o + t.cell(points) for t, o in zip(trees, offsets)])
        return pd.Series(found.astype("int32").tolist())

    return cells


def _first_cells(boxes: Boxes, width: int, k: int):
    @F.pandas_udf("array<int>")
    def cells(tree: pd.Series, *columns: pd.Series) -> pd.Series:
        return pd.Series(boxes.nearest(tree.to_numpy(), _frame(columns), width, k))

    return cells


def _other_cells(boxes: Boxes, width: int):
    @F.pandas_udf("array<int>")
    def cells(tree: pd.Series, edge: pd.Series, home: pd.Series, *columns: pd.Series) -> pd.Series:
        near = boxes.within(tree.to_numpy(), _frame(columns), width, edge.to_numpy("float64"))
        return pd.Series([np.setdiff1d(a, b).astype("int32").tolist() for a, b in zip(near, home)])

    return cells


def _boxes(donors: DataFrame, known: list[str], offsets: list[int]) -> Boxes:
    """One row per cell, MAX_CELLS and a few more a tree, reaches the driver."""
    found = donors.groupBy("cell").agg(F.count("*").alias("n"), *[
        f(g).alias(f"{name}{j}") for j, g in enumerate(known) for name, f in (("low", F.min), ("high", F.max), ("has", F.count))
    ]).orderBy("cell").toPandas()
    cell, rows = found["cell"].to_numpy(), found["n"].to_numpy()

    def matrix(name: str) -> np.ndarray:
        return np.column_stack([found[f"{name}{j}"].to_numpy("float64", na_value=np.nan) for j in range(len(known))])

    has = matrix("has")
    return Boxes(cell, np.searchsorted(offsets, cell, "right") - 1, rows, matrix("low"), matrix("high"),
                 has == rows[:, None], has > 0)


def knn_impute(
    df: DataFrame, column: str, key: list[str], k: int = 5, columns: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Fill nulls of ``column`` with the mean of its k nearest donors.

    Distance is Euclidean over the numeric columns both rows have, scaled up
    for missing ones; ties go to the smaller key. ``key`` must identify rows.
    NaN and infinite features count as missing. A row that shares no column with
    any donor gets the mean. Donors are held once per tree, one tree for each
    column that is some query's widest, at most as many as there are columns.
    """
    if not key:
        raise DataValidationError("knn imputation needs a unique key")
    numeric = columns or kinds.numeric_columns(df)
    others = [c for c in numeric if c != column]
    if not others:
        raise DataValidationError("knn imputation needs a second numeric column")
    features, known = [f"f{i}" for i in range(len(others))], [f"g{i}" for i in range(len(others))]
    width = len(others) + 1

    def finite(name: str) -> Column:
        value = col(name).cast("double")
        return F.when(F.abs(value) < math.inf, value)

    rows = df.select(*[col(c) for c in key], col(column).cast("double").alias("y"),
                     *[finite(c).alias(f) for c, f in zip(others, features)])
    donors = rows.where(F.col("y").isNotNull()).select(
        *[col(c).alias(f"d_{c}") for c in key], "y", *[F.col(f).alias(g) for f, g in zip(features, known)])
    facts = donors.agg(F.count("*").alias("n"), F.avg("y").alias("mean"),
                       *[F.var_samp(g).alias(f) for f, g in zip(features, known)]).first()
    n = facts["n"]
    if n == 0:
        return df
    k = min(k, n)
    # Columns from the widest to the narrowest; a query's tree leaves out those wider than any it has.
    order = sorted(range(len(others)), key=lambda j: -(facts[features[j]] or 0.0))
    widest = F.coalesce(*[F.when(F.col(features[j]).isNotNull(), F.lit(place)) for place, j in enumerate(order)])
    queries = rows.where(F.col("y").isNull()).select(
        *[col(c).alias(f"q_{c}") for c in key], *features, widest.alias("place")).where(F.col("place").isNotNull())
    places = sorted(r["place"] for r in queries.select("place").distinct().collect())
    if not places:
        places = [0]
    sample = donors.where(key_bits([col(f"d_{c}") for c in key], "knn") < hash_limit(n, SAMPLE_ROWS)).select(*known)
    points = sample.toPandas().to_numpy("float64", na_value=np.nan)
    cells = min(max(n // cell_rows, 1), MAX_CELLS)
    trees = [grow(points, order[place:], cells) for place in places]
    offsets = np.cumsum([0, *[t.cells for t in trees]])[:-1].tolist()

    donors = materialize(donors.withColumn("cell", F.explode(_cells_of(trees, offsets)(*known))), "knn-cells")
    boxes = _boxes(donors, known, offsets)
    slices = {int(c): math.ceil(size / cell_rows) for c, size in zip(boxes.cell, boxes.rows)}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`q_{c}` {types[c]}" for c in key], *[f"`d_{c}` {types[c]}" for c in key],
                        "dist double", "y double"])
    search = _nearest(k, width, features, known, key)
    q_key = [f"q_{c}" for c in key]
    tree = F.coalesce(*[F.when(F.col("place") == place, F.lit(i)) for i, place in enumerate(places)])
    homed = queries.withColumn("tree", tree)
    homed = materialize(homed.withColumn("home", _first_cells(boxes, width, k)("tree", *features)), "knn-home")

    first_visits = homed.withColumn("cell", F.explode("home")).select("cell", *q_key, *features)
    # Read twice below, and the search is the costly part: keep it as a table.
    first = materialize(_top(_search(first_visits, donors, slices, search, schema, key, features, known), key, k), "knn")
    bound = first.groupBy(*q_key).agg(F.max("dist").alias("far"), F.count("*").alias("found"))
    edge = F.when(F.col("found") >= k, F.col("far")).otherwise(F.lit(math.inf))
    others_of = _other_cells(boxes, width)("tree", "edge", "home", *features)
    second_visits = (homed.join(bound, q_key, "left").withColumn("edge", edge)
                     .withColumn("cell", F.explode(others_of)).select("cell", *q_key, *features))
    second = _search(second_visits, donors, slices, search, schema, key, features, known)
    best = _top(first.unionByName(second), key, k)
    # Whatever reads the filled table would search again: keep one row a query.
    values = materialize(best.groupBy(*q_key).agg(F.avg("y").alias("__knn")).select(
        *[col(f"q_{c}").alias(c) for c in key], "__knn"), "knn-values")
    filled = df.join(values, key, "left")
    return filled.select(*[
        F.coalesce(col(column).cast("double"), F.when(col(column).isNull(), F.coalesce("__knn", F.lit(facts["mean"]))))
        .alias(column) if c == column else col(c) for c in df.columns])
