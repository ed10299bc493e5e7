"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample of vectors is cut into parts of equal size
so that few neighbours are separated. A small classifier learns which part a
vector belongs to, with the parts of its neighbours as targets. Every vector of
the table goes to its most probable part; a query visits its most probable parts,
as many as it takes for their probabilities to add up to a limit, and is held
against all their vectors in double precision. The limit is set on the sample, so
that its own neighbours are found at the wanted rate: the less the vectors are
clustered, the more parts a query visits.

Defined cases: vectors that are null, zero, or hold null or non-finite values, and
rows without an id, take no part; so do vectors whose length is not the most
common one; rows that repeat an id are one vector each, and the nearest of them
counts; a query has all candidates if these are fewer; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparktidy.session import materialize


@dataclass(frozen=True)
class Index:
    """Parameters of index and search."""

    k: int = 10
    sample: int = 4_000  # vectors the index is fitted on, at most about
    graph: int = 10  # neighbours per vector in the graph
    least_parts: int = 8
    most_parts: int = 64
    hidden: int = 64
    rounds: int = 300
    recall: float = 0.96  # wanted on the sample
    rows: int = 4_096  # candidates of a block
    queries: int = 512  # queries held against a block at once
    seed: int = 5


def nearest(points: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of ``among`` for each point, in blocks."""
    out, square = [], (among ** 2).sum(1)
    for at in range(0, len(points), 512):
        d = square - 2 * points[at: at + 512] @ among.T
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def bisect(graph: np.ndarray, members: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size: order by a smooth vector on the graph, then swap
    pairs of nodes while that keeps more neighbours together."""
    place = np.full(len(graph), -1)
    place[members] = np.arange(len(members))
    near = place[graph[members]]
    row, col = np.nonzero(near >= 0)
    a, b = row, near[row, col]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])  # both ways
    degree = np.bincount(a, minlength=len(members)) + 1.0
    value = draw.normal(size=len(members))
    for _ in range(60):
        value = (np.bincount(a, value[b], len(members)) + value) / degree
        value -= np.average(value, weights=degree)
        value /= np.linalg.norm(value) + 1e-300
    right = np.zeros(len(members), bool)
    right[np.argsort(value, kind="stable")[len(members) // 2:]] = True
    for _ in range(20):
        outside = np.bincount(a, right[a] != right[b], len(members))
        gain = 2 * outside - np.bincount(a, minlength=len(members))
        lefts, rights = np.flatnonzero(~right), np.flatnonzero(right)
        lefts, rights = lefts[np.argsort(-gain[lefts], kind="stable")], rights[np.argsort(-gain[rights], kind="stable")]
        n = min(len(lefts), len(rights), max(1, len(members) // 40))
        good = gain[lefts[:n]] + gain[rights[:n]] > 0
        if not good.any():
            break
        right[lefts[:n][good]], right[rights[:n][good]] = True, False
    return members[~right], members[right]


def cut_graph(graph: np.ndarray, parts: int, draw: np.random.Generator) -> np.ndarray:
    """Part of each node, by halving again and again."""
    pieces = [np.arange(len(graph))]
    while len(pieces) < parts:
        pieces = [half for piece in pieces for half in bisect(graph, piece, draw)]
    part = np.zeros(len(graph), int)
    for i, piece in enumerate(pieces):
        part[piece] = i
    return part


class Router:
    """The classifier: one hidden layer, fitted with the graph's parts."""

    def __init__(self, points: np.ndarray, parts: int, how: Index):
        draw = np.random.Generator(np.random.PCG64(how.seed))
        self.parts, self.limit = parts, 1.0
        if parts == 1:
            return
        mixed = draw.permutation(len(points))
        unseen, points = points[mixed[: len(points) // 3]], points[mixed[len(points) // 3:]]
        graph = nearest(points, points, how.graph + 1)
        part = cut_graph(graph, parts, draw)
        target = np.stack([np.bincount(row, minlength=parts) for row in part[graph]]) + how.graph * np.eye(parts)[part]
        target = target / target.sum(1, keepdims=True)
        self.center, self.scale = points.mean(0), points.std() + 1e-12
        x, n = (points - self.center) / self.scale, points.shape[1]
        sizes = [(n, how.hidden), (how.hidden,), (how.hidden, parts), (parts,)]
        self.w = [draw.normal(0, 1 / math.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
        first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
        for step in range(1, how.rounds + 1):  # Adam on the whole sample
            hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
            wrong = (self._soft(hidden @ self.w[2] + self.w[3]) - target) / len(x)
            back = (wrong @ self.w[2].T) * (hidden > 0)
            slopes = [x.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ wrong + 1e-4 * self.w[2], wrong.sum(0)]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] -= 0.01 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        self.limit = self._limit(unseen, nearest(unseen, unseen, how.graph + 1), how)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def chances(self, points: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(points), 1))
        x = (points - self.center) / self.scale
        return self._soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])

    def _limit(self, points: np.ndarray, graph: np.ndarray, how: Index) -> float:
        """Least sum of probabilities at which neighbours are found, among vectors
        that the classifier has not seen."""
        chance = self.chances(points)
        own = chance.argmax(1)
        order = np.argsort(-chance, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(chance, order, 1), 1) - np.take_along_axis(chance, order, 1)
        ahead = np.empty_like(before)
        np.put_along_axis(ahead, order, before, 1)  # what the parts before a part add up to
        need = np.take_along_axis(ahead, own[graph], 1)  # a neighbour is found if the limit is above this
        need = np.sort(need[graph != np.arange(len(graph))[:, None]])
        return float(min(1.0, need[min(len(need) - 1, math.ceil(how.recall * len(need)))] + 1e-9)) if len(need) else 1.0

    def visits(self, points: np.ndarray) -> list[np.ndarray]:
        """Parts each point visits, most probable first."""
        chance = self.chances(points)
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, 1)
        number = ((np.cumsum(ranked, 1) - ranked) < self.limit).sum(1)
        return [row[:n].astype(np.int32) for row, n in zip(order, np.maximum(number, 1))]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as ``vec_id, v`` in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("n"),
                          F.coalesce(fine, F.lit(False)).alias("fine")).where("fine AND vec_id IS NOT NULL")
    common = rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.col("n") == (common["n"] if common else 0)).select("vec_id", "v")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, how: Index = Index()) -> tuple[Router, int]:
    """Router and number of rows. The sample is drawn by a hash of the id."""
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("index"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(draw < min(1.0, how.sample / max(1, total))).select("v").toArrow()
    points = np.unique(_matrix(taken.column("v")), axis=0) if taken.num_rows else np.zeros((0, 1))
    wanted = 2 ** round(math.log2(max(1.0, math.sqrt(total) / 8)))
    parts = min(how.most_parts, max(how.least_parts, wanted))
    while parts > 1 and len(points) < 8 * parts:  # too few vectors to tell so many parts apart
        parts //= 2
    return Router(points, parts, how), total


def _closest(queries: pa.Table, rows: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query, ids and distances of its k nearest rows; ties to smaller ids."""
    ids, points = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))
    square = (points ** 2).sum(1)
    for query, q in zip(queries.column("query_id").to_numpy(), _matrix(queries.column("q"))):
        rough = square - 2 * points @ q + q @ q
        rough[ids == query] = np.inf
        # wide enough for rows that repeat an id and for rounding
        edge = np.partition(rough, min(4 * k, len(rough) - 1))[min(4 * k, len(rough) - 1)]
        near = np.flatnonzero((rough <= edge + 1e-9 * (1 + abs(edge))) & np.isfinite(rough))
        exact = np.sqrt(((points[near] - q) ** 2).sum(1))
        order = np.lexsort((ids[near], exact))
        seen, first = np.unique(ids[near][order], return_index=True)
        if len(seen) < min(k, len(np.unique(ids[ids != query]))):  # repeats used the margin up
            near = np.flatnonzero(ids != query)
            exact = np.sqrt(((points[near] - q) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))
            _, first = np.unique(ids[near][order], return_index=True)
        order = order[np.sort(first)[:k]]
        yield query, ids[near][order], exact[order]


def search(vectors: DataFrame, how: Index = Index(), every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows whose id divides
    by ``every``, against all rows. Rows of a part are dealt into blocks, queries
    are dealt into groups, and a task sees one block and one group."""
    rows = usable(vectors)
    router, _ = fit(rows, how)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            visits = [[] for _ in ids]
            asked = np.flatnonzero(ids % every == 0)
            if len(asked):
                for i, parts in zip(asked, router.visits(points[asked])):
                    visits[i] = parts.tolist()
            own = router.chances(points).argmax(1).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(visits, pa.list_(pa.int32()))],
                                             ["vec_id", "v", "part", "visits"])

    placed = materialize(rows.mapInArrow(route, "vec_id long, v array<double>, part int, visits array<int>"), "routed")
    asked = placed.where(F.size("visits") > 0).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("visits").alias("part"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).collect()
    groups = asked.groupBy("part").agg(F.count("*").alias("n")).collect()

    def pieces(counts, most: int):
        listed = {r["part"]: max(1, -(-r["n"] // most)) for r in counts}
        table = F.array(*[F.lit(listed.get(p, 1)) for p in range(router.parts)])
        return table[F.col("part")]

    blocks, turns = pieces(sizes, how.rows), pieces(groups, how.queries)
    left = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = placed.select("vec_id", "v", "part", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), blocks).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))

    def compare(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = list(_closest(queries, candidates, how.k)) if queries.num_rows and candidates.num_rows else []
        return pa.table({
            "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                                 if found else np.zeros(0, np.int64)),
            "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)),
            "score": pa.array(np.concatenate([f[2] for f in found]) if found else np.zeros(0))})

    keys = ["part", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    half = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(half)).where(F.col("rank") <= how.k)
    whole = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= how.k).select(
        "query_id", "rank", "vec_id", "score")
