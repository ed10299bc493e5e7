"""Exact linear-interpolated quantiles that stay distributed.

Spark's exact ``percentile`` keeps a value -> count map in one task, so it only
serves small tables.  Otherwise one sketch pass brackets every wanted quantile,
and one grouped pass counts the rows of each interval while keeping the single
values inside the brackets, from which the wanted order statistics are read.
When the brackets themselves would be large, counting passes narrow them first.
Only cuts, counts and the wanted values reach the driver.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.functions.exprs import col, double_array

# Rows one task may hold as a value -> count map.
DIRECT_LIMIT = 1_000_000
# Rows of one interval that one task may order.
INTERVAL_LIMIT = 1_000_000
# ``percentile`` walks its whole map once per probability, so long lists go the other way.
MAX_DIRECT_PROBS = 32
CUTS = 256
# Half-width of the bracket around a wanted quantile, and the sketch size that
# keeps the quantile inside it (a miss only costs more passes).
BRACKET, SKETCH_SIZE, MAX_SKETCH_SIZE = 1 / 200, 1000, 60_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], direct_limit: int = DIRECT_LIMIT,
    interval_limit: int = INTERVAL_LIMIT,
) -> dict[str, list[float | None]]:
    """Quantiles of the non-null values of each column."""
    if not columns:
        return {}
    names = [f"c{i}" for i in range(len(columns))]
    data = df.select(*[col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    rows = data.count()
    if rows <= direct_limit and len(probs) <= MAX_DIRECT_PROBS:
        row = data.agg(*[F.percentile(n, double_array(probs)).alias(n) for n in names]).first()
        return {c: list(row[n]) if row[n] is not None else [None] * len(probs) for c, n in zip(columns, names)}
    found = _Search(data, names, probs, interval_limit).run(rows)
    return {c: found[n] for c, n in zip(columns, names)}


def approx_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10000
) -> dict[str, list[float | None]]:
    """One-pass sketch for callers who accept a rank error of 1/accuracy."""
    if not columns:
        return {}
    row = df.agg(*[
        F.percentile_approx(col(c).cast("double"), double_array(probs), accuracy).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(columns)}


def quantiles(df, columns, probs, accuracy: int | None = None) -> dict[str, list[float | None]]:
    return approx_quantiles(df, columns, probs, accuracy) if accuracy else exact_quantiles(df, columns, probs)


def _sketch(v: Column, cuts: int = 0) -> Column:
    """The more cuts are read from a sketch, the larger it is."""
    return F.kll_sketch_agg_double(F.nanvl(v, F.lit(None)), F.lit(min(max(SKETCH_SIZE, 4 * cuts), MAX_SKETCH_SIZE)))


def _read(sketch: str, probs: list[float]) -> Column:
    ranks = double_array(probs)
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def cut_values(df: DataFrame, values: dict[str, Column], pieces: int) -> tuple[int, dict[str, list[float]]]:
    """Row count, and per expression the borders of ``pieces`` pieces of about
    equal frequency, from one pass of mergeable sketches. Borders may repeat."""
    pieces = max(pieces, 2)
    spread = double_array([i / pieces for i in range(1, pieces)])
    row = (df.agg(F.count("*").alias("__rows"), *[_sketch(v, pieces).alias(n) for n, v in values.items()])
           .select("__rows", *[F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, spread)).alias(n)
                               for n in values]).first())
    return row["__rows"], {n: list(row[n]) if row[n] is not None else [] for n in values}


def as_splits(values) -> list[float]:
    """Strictly increasing borders that cover the whole axis, at least one inside."""
    inner = sorted({v for v in values if v is not None and math.isfinite(v)})
    return [-math.inf, *(inner or [0.0]), math.inf]


class _Search:
    """Order statistics of several columns at once. Interval ``part`` of a
    column holds the values from its border up to the next one."""

    def __init__(self, data: DataFrame, names: list[str], probs: list[float], interval_limit: int):
        self.data, self.names, self.probs, self.limit = data, names, probs, interval_limit
        self.number = {n: i for i, n in enumerate(names)}
        self.totals: dict[str, int] = {}

    def run(self, rows: int) -> dict[str, list[float | None]]:
        few = len(self.probs) <= MAX_DIRECT_PROBS
        if few:
            grid = sorted({min(max(p + d, 0.0), 1.0) for p in self.probs for d in (-BRACKET, BRACKET)})
        else:
            grid = sorted({*self.probs, *(i / CUTS for i in range(CUTS + 1))})
        facts = (self.data.agg(*[e for n in self.names for e in (
            _sketch(F.col(n)).alias(n), F.count(n).alias(f"{n}_total"))])
            .select(*[e for n in self.names for e in (_read(n, grid).alias(n), F.col(f"{n}_total"))]).first())
        cuts = {n: list(facts[n]) if facts[n] is not None else [] for n in self.names}
        self.totals = {n: facts[f"{n}_total"] for n in self.names}
        splits = {n: as_splits(cuts[n]) for n in self.names}
        narrowed = rows * 2 * BRACKET > self.limit if few else rows / CUTS > self.limit
        if narrowed:
            splits, wanted = self._split_large(splits)
        else:
            wanted = {n: self._bracketed(splits[n], dict(zip(grid, cuts[n]))) for n in self.names}
        found = self._pick(splits, wanted)
        if found is None:  # a sketch missed: locate the ranks by counting
            found = self._pick(*self._split_large(splits))
        return found

    def _bracketed(self, splits: list[float], cut: dict[float, float]) -> set[int]:
        """Intervals between the cuts on both sides of each wanted quantile."""
        if not cut:
            return set()
        if len(self.probs) > MAX_DIRECT_PROBS:
            return set(range(len(splits) - 1))
        out = set()
        for p in self.probs:
            low, high = cut[max(p - BRACKET, 0.0)], cut[min(p + BRACKET, 1.0)]
            out |= {i for i, (a, b) in enumerate(zip(splits, splits[1:])) if a <= high and b > low}
        return out

    def _cells(self, splits: dict[str, list[float]]) -> DataFrame:
        """``name, part, v`` for every non-null value, in one scan."""
        cut = Bucketizer(
            splitsArray=[splits[n] for n in self.names], inputCols=self.names,
            outputCols=[f"{n}_part" for n in self.names], handleInvalid="keep").transform(self.data)
        cells = F.array(*[
            F.struct(F.lit(self.number[n]).alias("name"), F.col(f"{n}_part").cast("int").alias("part"),
                     F.col(n).alias("v")) for n in self.names])
        return cut.select(F.inline(cells)).where(F.col("v").isNotNull())

    def _split_large(self, splits):
        """Count the intervals and split those that hold a wanted rank and too
        many rows, until none is left. Returns the borders and wanted intervals."""
        while True:
            cells = self._cells(splits)
            counted = cells.groupBy("name", "part").agg(
                F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            wanted: dict[str, set[int]] = {n: set() for n in self.names}
            large = []
            for n in self.names:
                parts = sorted((r for r in counted if r["name"] == self.number[n]), key=lambda r: r["part"])
                ranks = _ranks(self.totals[n], self.probs)
                before = 0
                for r in parts:
                    if any(before <= k < before + r["n"] for k in ranks):
                        wanted[n].add(r["part"])
                        if r["n"] > self.limit and r["lo"] < r["hi"]:
                            large.append((self.number[n], r["part"]))
                    before += r["n"]
            if not large:
                return splits, wanted
            marked = F.broadcast(self.data.sparkSession.createDataFrame(large, "name int, part int"))
            inner = [i / CUTS for i in range(1, CUTS)]
            finer = (cells.join(marked, ["name", "part"], "left_semi").groupBy("name", "part")
                     .agg(_sketch(F.col("v")).alias("s"), F.max("v").alias("hi"))
                     .select("name", "hi", _read("s", inner).alias("q")).collect())
            old = {n: list(s) for n, s in splits.items()}
            for r in finer:
                n, q = self.names[r["name"]], r["q"] or []
                # The largest value and the neighbour of the smallest cut become
                # borders too, so one repeated value gets an interval of its own.
                fence = [r["hi"], *([math.nextafter(q[0], math.inf)] if q else [])]
                splits[n] = as_splits([*splits[n], *q, *fence])
            if splits == old:  # only infinite values are left to tell apart
                return splits, wanted

    def _pick(self, splits, wanted) -> dict[str, list[float | None]] | None:
        """Read the wanted ranks; None when one lies outside the wanted intervals."""
        tests = [f"(name = {self.number[n]} AND part IN ({','.join(map(str, sorted(wanted[n])))}))"
                 for n in self.names if wanted[n]]
        open_cell = F.expr(" OR ".join(tests) or "false")
        groups = (
            self._cells(splits).select("name", "part", "v", F.when(open_cell, F.col("v")).alias("value"))
            .groupBy("name", "part", "value")
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        by_part = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = groups.groupBy("name", "part").agg(F.sum("n").alias("rows")).select(
            "name", "part", "rows", F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("before"))
        ranks = self.data.sparkSession.createDataFrame(
            [(self.number[n], k) for n in self.names for k in _ranks(self.totals[n], self.probs)],
            "name int, rank long")
        targets = parts.join(F.broadcast(ranks), "name").where(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows"))).select(
            "name", "part", "rank", (F.col("rank") - F.col("before")).alias("local"))
        inside = Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        hits = (
            groups.withColumn("upto", F.sum("n").over(inside))
            .join(F.broadcast(targets), ["name", "part"])
            .where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
            .select("name", "rank", F.coalesce("value", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).alias("v")).collect())
        if any(r["v"] is None for r in hits):
            return None
        known = {n: {} for n in self.names}
        for r in hits:
            known[self.names[r["name"]]][r["rank"]] = r["v"]
        return {n: [_interpolate(self.totals[n], p, known[n]) for p in self.probs] for n in self.names}


def _ranks(total: int, probs: list[float]) -> set[int]:
    spots = [p * (total - 1) for p in probs] if total else []
    return {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}


def _interpolate(total: int, prob: float, known: dict[int, float]) -> float | None:
    if not total:
        return None
    spot = prob * (total - 1)
    low, high = math.floor(spot), math.ceil(spot)
    return known[low] if low == high else (high - spot) * known[low] + (spot - low) * known[high]
