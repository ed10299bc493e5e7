"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An
n-gram's vector binds its letters: each is rotated by its place and all are
multiplied. A text's profile bundles (adds) the vectors of its n-grams; a
language's prototype bundles the profiles of its texts, each at length one. A
text gets the language whose prototype has the largest cosine with its profile.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
every text when nothing could be learned; equal cosines go to the smaller name;
repeated rows are predicted one by one; further columns are not read. Any number of
languages works: a prototype is 8 KB on the driver and 4 KB in a worker, tasks give
their sums back when they hold many, and the shares of languages are broadcast only
while they are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm.tables import small_batches
from sparktidy.session import materialize

SIZE = 1024  # components of a vector
GRAM = 3
BLOCK_LETTERS = 1 << 19  # letters whose n-grams are counted at once
FEW_LANGUAGES = 50_000  # shares are broadcast up to so many
HELD_LANGUAGES = 2048  # sums a task holds, and prototypes compared at once


@dataclass(frozen=True)
class Profiles:
    """The fit's bound; all rows are predicted."""

    most_per_language: int = 4_000


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    """+1 and -1 by the bits of a generator seeded with the code point."""
    bits = np.random.Generator(np.random.PCG64([code, 77])).integers(0, 2, SIZE, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row per n-gram (a row of code points): rotated letters, multiplied."""
    codes, place = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in codes])
    place = place.reshape(grams.shape)
    bound = letters[place[:, -1]]
    for k in range(2, grams.shape[1] + 1):
        bound = bound * np.roll(letters, k - 1, axis=1)[place[:, -k]]
    return bound


@lru_cache(maxsize=1 << 16)
def _folded(code: int) -> int:
    """Lower-case letter of a code point, 0 for anything else."""
    char = chr(code)
    return ord(char.lower()[0]) if char.isalpha() else 0


def _letters(text: str) -> np.ndarray:
    """Letters with a gap (0) between words and at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known, place = np.unique(codes, return_inverse=True)
    codes = np.array([_folded(int(c)) for c in known], np.uint32)[place]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def profiles(texts: list[str | None]) -> np.ndarray:
    """One profile per text, in blocks: n-grams of a block are counted per text
    and multiplied with the block's distinct n-gram vectors."""
    out = np.zeros((len(texts), SIZE), np.float32)
    rows, pieces, held = [], [], 0

    def flush():
        nonlocal rows, pieces, held
        if not rows:
            return
        codes, owner = np.concatenate(pieces), np.concatenate(rows)
        key = (codes[:, 0].astype(np.uint64) << np.uint64(42)) | (codes[:, 1].astype(np.uint64) << np.uint64(21)) | codes[:, 2]
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        low, high = int(owner.min()), int(owner.max()) + 1
        for at in range(0, len(distinct), 4096):
            mine = (place >= at) & (place < at + 4096)
            width = min(4096, len(distinct) - at)
            counts = np.bincount((owner[mine] - low) * width + place[mine] - at, minlength=(high - low) * width)
            out[low:high] += counts.reshape(high - low, width).astype(np.float32) @ gram_vectors(codes[first[at: at + width]])
        rows, pieces, held = [], [], 0

    for row, text in enumerate(texts):
        codes = _letters(text or "")
        if len(codes) < GRAM:
            continue
        for at in range(0, len(codes) - GRAM + 1, BLOCK_LETTERS):
            part = codes[at: at + BLOCK_LETTERS + GRAM - 1]
            grams = np.lib.stride_tricks.sliding_window_view(part, GRAM)
            grams = grams[grams[:, 1] != 0]  # a gap in the middle joins two words
            pieces.append(grams)
            rows.append(np.full(len(grams), row, np.int64))
            held += len(grams)
            if held > BLOCK_LETTERS:
                flush()
    flush()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def learn(docs: DataFrame, how: Profiles = Profiles()) -> dict[str, np.ndarray]:
    """Prototypes of the languages, from at most about so many texts of each,
    chosen by a hash of the id. Tasks return one sum per language."""
    usable = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.least(
        F.lit(1.0), F.lit(float(how.most_per_language)) / F.col("n"))).select("lang", "share")
    counts = materialize(counts, "shares")
    draw = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # texts stay where they are while the shares are few
    shares = F.broadcast(counts) if counts.count() <= FEW_LANGUAGES else counts
    sample = usable.join(shares, "lang").where(draw < F.col("share")).select("lang", "text")

    def told(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = sorted(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, SIZE).tolist() if names else [], pa.string()),
             pa.array(np.tile(np.arange(SIZE), len(names)), pa.int32()),
             pa.array(np.concatenate([sums[n] for n in names]) if names else [], pa.int64())], ["lang", "at", "v"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                unit = _unit(profiles(part.column(1).to_pylist()))
                for lang, row in zip(part.column(0).to_pylist(), unit):
                    sums[lang] = sums.get(lang, 0) + np.rint(row * 4096).astype(np.int64)
                if len(sums) > HELD_LANGUAGES:
                    yield told(sums)
                    sums = {}
        yield told(sums)

    summed = sample.mapInArrow(bundle, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    whole = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v"))
    found = {row["lang"]: np.array(row["v"], np.int64)
             for row in whole.select("lang", F.col("v.v").alias("v")).toLocalIterator()}
    return {lang: v for lang, v in found.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    names = sorted(prototypes)
    blocks = [_unit(np.stack([prototypes[n] for n in names[at: at + HELD_LANGUAGES]])).astype(np.float32)
              for at in range(0, len(names), HELD_LANGUAGES)]
    width = HELD_LANGUAGES

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if names:
                    own = profiles(part.column(1).to_pylist())
                    unit, rows = _unit(own), np.arange(part.num_rows)
                    best, most = np.zeros(part.num_rows, int), np.full(part.num_rows, -np.inf)
                    for first, block in zip(range(0, len(names), width), blocks):
                        cosine = (unit @ block.T).astype(np.float64)
                        at_best = cosine.argmax(axis=1)
                        better = cosine[rows, at_best] > most  # a tie stays with the smaller name
                        best[better], most[better] = first + at_best[better], cosine[rows, at_best][better]
                    for i in np.flatnonzero(own.any(axis=1)):
                        said[i], score[i] = names[best[i]], min(1.0, max(0.0, most[i]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(score)],
                                                 ["doc_id", "lang_pred", "score"])

    narrow = docs.select("doc_id", "text")
    out = narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    small_batches(docs.sparkSession)
    return predict(docs, learn(docs, how))
