"""Toxicity by a weighted lexicon.

Texts are folded first: accents and look-alike letters become plain letters,
digits and signs inside words become the letters they stand for. One automaton
(Aho-Corasick) finds all lexicon entries and exception phrases in one pass over
the folded text; a hit inside an exception phrase does not count. The weights of
the hits, one per word, are normalised by the text's length and calibrated.

Lexicon, exceptions and calibration are learned from a bounded sample of labelled
documents. Entries are whole words and word beginnings. An entry's support is the
number of different words it follows, not of documents, so that a document with
many copies does not put its own vocabulary into the lexicon.

Defined cases: a null or empty text scores as a text without hits; without usable
labels the lexicon is empty and every score is the share of toxic labels (0 if
there are none); several labels of one document count as toxic if one does;
repeated rows are scored one by one; further columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm.tables import small_batches
from sparktidy.llm.words import parts

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "ь": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e",
    "є": "e", "ё": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i", "ӏ": "i", "ј": "j", "к": "k",
    "κ": "k", "м": "m", "ո": "n", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p", "ρ": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w",
    "х": "x", "χ": "x", "у": "y", "γ": "y", "ø": "o", "đ": "d", "ł": "i", "ß": "ss", "æ": "ae", "œ": "oe",
}
# What digits and signs stand for. As 1 is read as i and as l, both letters are one.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                            "@": "a", "$": "s", "!": "i", "|": "i"})
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"  # fixed: characters without width
LETTERS = str.maketrans(LOOKALIKES | {"l": "i"} | dict.fromkeys(HIDDEN))
MARKS = re.compile("[\u0300-\u036f]+")
SUBSTITUTED = re.compile(r"(?<=[a-z])[0-9@$!|]+(?=[a-z])|(?<![0-9a-z@$!|])[@$](?=[a-z])|(?<![0-9a-z])[0-9]{1,2}(?=[a-z])|(?<=[a-z])[0-9]{1,2}(?![0-9a-z])")
STAND_INS = re.compile("[0-9@$!|]")
GAP = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Learning:
    """Bounds and limits of the fit; all rows are scored."""

    most_toxic: int = 5_000  # labelled documents of either kind in the sample
    most_other: int = 10_000
    most_candidates: int = 100_000  # entries of toxic documents, by support
    least_support: int = 6  # different words before an entry, in toxic documents
    least_weight: float = 2.5  # log odds
    most_entries: int = 20_000
    beginnings: tuple[int, ...] = (4, 5, 6)
    exception_support: int = 5
    exception_share: float = 0.1  # of a phrase's hits, in toxic documents at most


def fold(text: str | None) -> str:
    """Folded words, one blank between them and at both ends."""
    text = (text or "").lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    text = text.translate(LETTERS) if not text.isascii() else text.replace("l", "i")
    if STAND_INS.search(text):
        text = SUBSTITUTED.sub(lambda m: m[0].translate(STANDS_FOR), text).replace("l", "i")
    return f" {GAP.sub(' ', text).strip()} "


def held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether the id's CRC-32 falls into the part that is kept from learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(labels: DataFrame, name: str, most: dict[int, int]) -> DataFrame:
    """``doc_id, label`` of labelled rows open to learning, thinned by a hash of
    the id to about the bounds; few enough to be broadcast, by parameter."""
    usable = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max(name).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most.get(label, 0) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return usable.where(draw < share)


def _entries(word: str, beginnings: tuple[int, ...]) -> list[str]:
    """What a folded word may be in the lexicon as: itself and its beginnings."""
    if len(word) < 3:
        return []
    return [f" {word} ", *(f" {word[:n]}" for n in beginnings if len(word) > n)]


def _supports(beginnings: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                before = 0
                for word in fold(text).split():
                    seen.update((entry, before) for entry in _entries(word, beginnings))
                    before = zlib.crc32(word.encode())
            rows = list(zip(*seen)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64())],
                                             ["entry", "before"])

    return run


def _occurrences(wanted: frozenset[str], beginnings: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                for word, n in Counter(fold(text).split()).items():
                    for entry in _entries(word, beginnings):
                        if entry in wanted:
                            seen[entry] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             ["entry", "n"])

    return run


def learn_lexicon(sample: DataFrame, how: Learning) -> dict[str, float]:
    """Entries with their log odds from ``text, label`` rows. Toxic documents name
    the candidates, with their support; the others are only asked how often they
    hold them."""
    words = {r["label"]: r["n"] for r in sample.groupBy("label").agg(
        F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    if not words.get(1) or not words.get(0):
        return {}
    found = sample.where("label = 1").select("text").mapInArrow(
        _supports(how.beginnings), "entry string, before long").distinct()
    named = found.groupBy("entry").agg(F.count("*").alias("t")).where(F.col("t") >= how.least_support)
    support = {r["entry"]: r["t"] for r in named.orderBy(F.desc("t"), "entry").limit(how.most_candidates).collect()}
    held = sample.where("label = 0").select("text").mapInArrow(
        _occurrences(frozenset(support), how.beginnings), "entry string, n long")
    other = {r["entry"]: r["n"] for r in held.groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    weights = {e: math.log((t + 0.5) / (words[1] + 1)) - math.log((other.get(e, 0) + 0.5) / (words[0] + 1))
               for e, t in support.items()}
    kept = sorted((e for e, w in weights.items() if w >= how.least_weight), key=lambda e: (-support[e] * weights[e], e))
    return {e: weights[e] for e in kept[: how.most_entries]}


class Matcher:
    """The automaton over entries and exception phrases, both as folded."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        self.machine = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not len(self.machine)
        self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, float]:
        """Start of each word that is hit, in a folded text, and its highest weight."""
        found: dict[int, float] = {}
        if self.empty:
            return found
        free = []
        for end, (size, weight) in self.machine.iter(text):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if free:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in free)}
        return found

    def measure(self, text: str | None) -> float:
        folded = fold(text)
        return sum(self.hits(folded).values()) / math.log(2 + folded.count(" "))


def _phrases(matcher: Matcher):
    def run(batches):
        for batch in batches:
            rows: dict[tuple[str, int], int] = defaultdict(int)
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                for start in matcher.hits(folded):
                    words = folded[start + 1:].split(" ", 2)
                    before = folded[:start].rsplit(" ", 1)[-1]
                    if len(words) > 1 and words[1]:
                        rows[f"{words[0]} {words[1]}", label] += 1
                    if before:
                        rows[f"{before} {words[0]}", label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.int32()),
                 pa.array(list(rows.values()), pa.int64())], ["phrase", "label", "n"])

    return run


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], how: Learning) -> list[str]:
    """Two-word phrases around hits that are seen in documents without toxicity."""
    if not lexicon:
        return []
    found = sample.select("text", "label").mapInArrow(
        _phrases(Matcher(lexicon, [])), "phrase string, label int, n long")
    counts = found.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("f"),
                                         F.sum("n").alias("n"))
    kept = counts.where((F.col("f") >= how.exception_support)
                        & (F.col("f") >= (1 - how.exception_share) * F.col("n")))
    return [r["phrase"] for r in kept.orderBy(F.desc("f"), "phrase").limit(how.most_entries).collect()]


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic ``a + b * x`` by Newton steps with a small ridge."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0
    design, theta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * theta
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(theta[0]), float(max(theta[1], 0.0))


def score_documents(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` per document."""
    small_batches(docs.sparkSession)
    chosen = labelled_sample(labels, "toxic", {0: how.most_other, 1: how.most_toxic})
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    lexicon = learn_lexicon(sample, how)
    matcher = Matcher(lexicon, learn_exceptions(sample, lexicon, how))

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([matcher.measure(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)],
                ["x", "label"])

    seen = sample.mapInArrow(measured, "x double, label int").toArrow()
    a, b = calibrate(seen.column("x").to_numpy(), seen.column("label").to_numpy().astype(float))

    def scored(batches):
        for batch in parts(batches):
            folded = [fold(t) for t in batch.column(1).to_pylist()]
            hits = [matcher.hits(t) for t in folded]
            x = np.array([sum(h.values()) / math.log(2 + t.count(" ")) for h, t in zip(hits, folded)], float)
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array([len(h) for h in hits], pa.int64())],
                ["doc_id", "score", "n_hits"])

    narrow = docs.select("doc_id", "text")
    out = narrow.mapInArrow(scored, f"doc_id {dict(narrow.dtypes)['doc_id']}, score double, n_hits long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
