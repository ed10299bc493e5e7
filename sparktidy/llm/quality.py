"""Quality scores: a kernel ridge model over document statistics.

Random Fourier features turn a Gaussian kernel into a linear model: with random
directions w and phases p, the products of cos(w x + p) approximate the kernel.
Each task adds up its rows' part of the normal equations, the few matrices are
added, and one small system is solved. An isotonic (never falling) map fitted on
rows that the ridge did not see turns its values into probabilities.

Learning uses a bounded sample of labelled rows; statistics are taken from whole
texts, and every row is scored.

Defined cases: a null or empty text has statistics of zero words and is scored
like any other; without usable labels every score is the share of good labels
(0 if there are none); several labels of one document count by the largest;
repeated rows are scored one by one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparktidy.llm import words as W
from sparktidy.llm.toxicity import held_out, labelled_sample
from sparktidy.llm.tables import small_batches
from sparktidy.session import materialize

NAMES = ["log_words", "word_chars", "long_words", "capitals", "digits", "signs", "marks", "beyond_ascii", "log_lines",
         "words_per_line", "same_as_before", "distinct_words", "top_pairs", "signed_words", "capital_words", "blanks"]


@dataclass(frozen=True)
class Kernel:
    """Parameters of the fit. ``most_rows`` bounds the labelled sample."""

    most_rows: int = 40_000
    features: int = 256
    width: float = 3.0  # of the Gaussian, in standard deviations of the statistics
    ridge: float = 1e-3
    tasks: int = 8  # that add up the normal equations
    bins: int = 2_000  # of ridge values for the isotonic map
    seed: int = 11


def _of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


UPPER, DIGIT = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789")
SIGNS, MARKS = _of("#*$%&|<>{}[]\\~^=+@_/"), _of("!?")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    out = np.zeros((len(texts), len(NAMES)))
    for first, last, raw, offsets in W.slices(texts):
        starts, ends, before = W.cut(raw, offsets)
        count = np.diff(before)
        owner = np.repeat(np.arange(last - first), count)
        words = W.hashes(raw, starts, ends)

        def summed(flags, offsets=offsets):
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

        def share(flags):
            return np.bincount(owner, flags, last - first) / np.maximum(count, 1)

        def inside(flags):
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[ends] - total[starts]

        size = np.maximum(np.diff(offsets), 1)
        chars = inside((raw & 0xC0) != 0x80)
        mixed = W.mix(words ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(mixed, kind="stable")
        repeat = np.zeros(len(words), bool)
        repeat[order[1:]] = mixed[order][1:] == mixed[order][:-1]
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        pairs = np.zeros(len(words), bool)
        if len(words) > 1:
            key = W.windows(words, 2) ^ W.mix(owner[1:].astype(np.uint64) + np.uint64(7))
            by = np.argsort(key, kind="stable")
            twice = np.zeros(len(key), bool)
            twice[by[1:]] = key[by][1:] == key[by][:-1]
            pairs[1:] = twice & (owner[1:] == owner[:-1])
        lines = summed(raw == 0x0A) + 1
        columns = [np.log1p(count), share(chars), share(chars > 14), summed(UPPER[raw]) / size, summed(DIGIT[raw]) / size,
                   summed(SIGNS[raw]) / size, summed(MARKS[raw]) / size, summed(raw >= 0x80) / size, np.log1p(lines),
                   np.log1p(count / lines), share(same), 1 - share(repeat), share(pairs),
                   share(inside(SIGNS[raw] | MARKS[raw]) > 0), share((inside(UPPER[raw]) > 1)), summed(W.GAPS[raw]) / size]
        out[first:last] = np.stack(columns, axis=1)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of whole texts, written once: a hundred bytes a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            found = statistics(batch.column(1)).astype(np.float32)
            offsets = np.arange(0, found.size + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
                ["doc_id", "stats"])

    small_batches(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    return materialize(narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, stats array<float>"), "stats")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


class Model:
    """Scaling, random features, ridge weights and the isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, kernel: Kernel):
        draw = np.random.Generator(np.random.PCG64(kernel.seed))
        self.mean, self.scale = mean, scale
        self.directions = draw.normal(0, 1 / kernel.width, (len(NAMES), kernel.features))
        self.phases = draw.uniform(0, 2 * np.pi, kernel.features)
        self.weights = np.zeros(kernel.features + 1)
        self.steps = (np.zeros(1), np.zeros(1))

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), *self.steps), 0, 1)


def pool(values: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means by pooling neighbours that fall; values come sorted."""
    blocks: list[list[float]] = []  # sum of good, weight, first value, last value
    for v, g, w in zip(values, good, weight):
        blocks.append([g, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, w2, _, last = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    y = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return x, y


def fit(stats: DataFrame, labels: DataFrame, kernel: Kernel = Kernel()) -> Model:
    """The model from a bounded labelled sample of ``doc_id, stats`` rows."""
    counts = {r["quality"]: r["count"] for r in labels.where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect() if r["quality"] is not None}
    share = min(1.0, kernel.most_rows / max(1, sum(counts.values())))
    chosen = labelled_sample(labels, "quality", {k: int(n * share) for k, n in counts.items()})
    rows = stats.join(F.broadcast(chosen), "doc_id").withColumn(
        "part", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(4)))
    rows = materialize(rows.select("stats", "label", "part").repartition(kernel.tasks), "sample")
    each = [F.col("stats")[i].cast("double") for i in range(len(NAMES))]
    said = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each], F.avg("label")).first()
    if said[0] is None:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), kernel)
    n = len(NAMES)
    model = Model(np.array(said[:n]), np.maximum(np.array(said[n: 2 * n]), 1e-6), kernel)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kernel.features + 1, kernel.features + 2))
        for batch in batches:
            z = model.features(_rows(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.where("part != 0").select("stats", "label").mapInArrow(sums, "sums array<double>").toArrow()
    total = parts.column("sums").combine_chunks().flatten().to_numpy().reshape(
        -1, kernel.features + 1, kernel.features + 2).sum(axis=0)
    known = max(1.0, total[-1, kernel.features])
    model.weights = np.linalg.solve(total[:, :-1] + kernel.ridge * known * np.eye(kernel.features + 1) / kernel.features,
                                    total[:, -1])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(model.ridge(_rows(batch.column(0))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(at * kernel.bins).astype(np.int64)), batch.column(1)],
                                             ["bin", "label"])

    bins = rows.where("part = 0").select("stats", "label").mapInArrow(values, "bin long, label int").groupBy("bin").agg(
        F.sum("label").cast("double").alias("good"), F.count("*").cast("double").alias("n")).orderBy("bin").toArrow()
    if bins.num_rows:
        model.steps = pool(bins.column("bin").to_numpy() / kernel.bins, bins.column("good").to_numpy(),
                           bins.column("n").to_numpy())
    else:
        model.steps = (np.zeros(1), np.array([float(said[2 * n])]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, kernel: Kernel = Kernel()) -> DataFrame:
    """``doc_id, held_out, score, predicted, ridge`` per document."""
    stats = measure(docs)
    model = fit(stats, labels, kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(own)), pa.array(model.ridge(own))], ["doc_id", "score", "ridge"])

    out = stats.mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, score double, ridge double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"), "ridge")
