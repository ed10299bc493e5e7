"""Importance resampling towards a target distribution over hashed n-grams.

Texts are cut by Arrow kernels: ``ascii_lower``, ``split_pattern_regex`` and
``list_flatten`` give the words, ``dictionary_encode`` their numbers. Neighbouring
numbers, shifted against each other, form pairs; pairs are numbered in the same way,
and only distinct words and pairs get a CRC (a pair's from the CRCs of its words,
as CRCs are linear). A bucket is the CRC modulo the number of buckets. One pass sums
buckets per task for the corpus and for the target; their log ratio is a bucket's
gain. The other pass takes the gains and reduces them by document. Gumbel noise from
a hash of the id turns "highest score" into a draw without replacement.

Ranks need no ordered pass over the table: scores are whole numbers, so counts per
score tell how many documents stand before each score, and only equal scores are
ordered among themselves.

Defined cases: a null text and one without words have no features and weight 0; a
null id hashes as an empty one and comes first among ties; ties of score and id are
ordered by a hash of the text, after which only equal rows are left; an empty corpus
gives an empty result, an empty target gives gains from the smoothing alone; further
columns are kept by ``resample``, but for those named like an output, which the
output replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.llm.tables import ddl, hide, small_batches
from sparktidy.session import materialize

#: Everything in ASCII that is neither a digit nor a small letter; capitals are folded before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE_BYTES = 2 << 20  # bytes of text whose features are numbered together; one longer text is a piece of its own
SHIFTS = 65  # words up to two bytes shorter get their pairs' CRCs from tables
OUT = ["n_words", "n_features", "weight", "score", "rank"]


@dataclass(frozen=True)
class Resample:
    """Parameters of the draw."""

    buckets: int = 10_000
    scale: int = 1000  # gains and noise are whole thousandths
    least_words: int = 20  # shorter documents are never drawn
    percent: int = 25  # share of the others that is drawn
    seed: str = "7"


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """CRC-32 after n zero bytes, for each of a CRC's four bytes: it is linear, so
    the CRC of joined strings is the first one's shifted, xor the second one's."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(SHIFTS):
        now = step[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out).reshape(-1)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined strings from those of their halves; ``length`` (at most
    ``SHIFTS``) is the second half's."""
    tables, at = _shift_tables(), length.astype(np.int64) * 1024
    return (tables[at + (first & 255)] ^ tables[at + 256 + (first >> 8 & 255)]
            ^ tables[at + 512 + (first >> 16 & 255)] ^ tables[at + 768 + (first >> 24)] ^ second)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A text column in pieces of bounded size; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + PIECE_BYTES, "right")))
        yield texts.slice(first, last - first)
        first = last


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the bucket of every word in order, and of every pair the
    bucket and the text's number."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), GAP)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)  # a text that begins or ends with a gap has an empty word there
    coded = flat.filter(full).dictionary_encode()
    owner = owner.filter(full).to_numpy().astype(np.int64)
    number = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    tail = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    both = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    pairs = pa.array(number[both] * max(1, len(words)) + number[both + 1]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), max(1, len(words)))
    near = size[right] <= SHIFTS
    pair_crc = np.zeros(len(left), np.uint32)
    pair_crc[near] = joined_crc(crc[left[near]], tail[right[near]], size[right[near]])
    for i in np.flatnonzero(~near):
        pair_crc[i] = zlib.crc32(b" " + words[right[i]], int(crc[left[i]]))
    word_bucket, pair_bucket = (crc % buckets).astype(np.int64), (pair_crc % buckets).astype(np.int64)
    return (np.bincount(owner, minlength=len(texts)), word_bucket[number],
            pair_bucket[pairs.indices.to_numpy()], owner[both])


def bucket_counts(docs: DataFrame, how: Resample = Resample(), text: str = "text") -> DataFrame:
    """``bucket, n`` over all whole texts. A task sends one row per bucket."""
    small_batches(docs.sparkSession)
    buckets = how.buckets

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                _, words, pairs, _ = features(piece, buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text).alias("__text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, how: Resample = Resample(), text: str = "text") -> np.ndarray:
    """One whole number per bucket: as many as the buckets, whatever the corpus."""
    counts = [np.zeros(how.buckets, np.float64) for _ in range(2)]
    for held, table in zip(counts, (docs, target)):
        for r in bucket_counts(table, how, text).collect():  # one row per bucket
            held[r.bucket] = r.n
    own, wanted = counts
    ratio = (wanted + 1) * (own.sum() + how.buckets) / ((own + 1) * (wanted.sum() + how.buckets))
    return np.floor(how.scale * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, how: Resample = Resample(), text: str = "text") -> DataFrame:
    """The columns and ``n_words, n_features, weight``: the floored mean of the
    gains over a document's features. No shuffle."""
    small_batches(docs.sparkSession)
    hidden, inner = hide(docs)
    at, buckets = list(inner).index(text), how.buckets
    new = ["n_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            first = 0
            for piece in pieces(batch.column(at)):
                n, words, pairs, owner = features(piece, buckets)
                edge = np.concatenate([[0], np.cumsum(n)])
                summed = np.concatenate([[0], np.cumsum(gain[words])])
                paired = np.concatenate([[0], np.cumsum(gain[pairs])])
                pair_edge = np.searchsorted(owner, np.arange(len(n) + 1))
                total = np.diff(summed[edge]) + np.diff(paired[pair_edge])
                n_features = n + np.maximum(n - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(n)) for c in batch.columns), pa.array(n), pa.array(n_features),
                     pa.array(np.where(n > 0, total // np.maximum(n_features, 1), 0))], [*inner.values(), *new])
                first += len(n)

    out = hidden.mapInArrow(run, f"{ddl(hidden)}, n_words long, n_features long, weight long")
    return out.select(*[F.col(i).alias(name) for name, i in inner.items() if name not in OUT], *new)


def noise(doc_id: Column, how: Resample = Resample()) -> Column:
    """Gumbel noise from the first eight hexadecimal digits of the id's sha256."""
    key = F.concat(F.lit(f"{how.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(how.scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, how: Resample = Resample(), doc_id: str = "doc_id", tie: str | None = None) -> DataFrame:
    """The table with ``score`` and ``rank``; undrawn documents have no rank.

    Scores are whole numbers of bounded size, so their counts are a small table
    whatever the corpus. Only the scores that are drawn from are shuffled, each
    on its own; the noise spreads documents over scores even if their texts are equal."""
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col(doc_id), how)), "scored")
    fit = F.col("n_words") >= how.least_words
    counted = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = counted.select(F.col("score").alias("__score"), F.coalesce(ahead, F.lit(0)).alias("__ahead"),
                           F.sum("n").over(whole).alias("__all"))
    steps = steps.withColumn("__wanted", F.expr(f"__all * {how.percent} div 100")).where("__ahead < __wanted")
    joined = scored.join(F.broadcast(steps), fit & (F.col("score") == F.col("__score")), "left")
    names = [F.col(c) for c in scored.columns]
    order = [F.col(doc_id).asc_nulls_first(), *([F.col(tie)] if tie else []), F.col("n_features")]
    place = F.row_number().over(Window.partitionBy("__score").orderBy(*order)) + F.col("__ahead")
    first = joined.where(F.col("__score").isNotNull()).withColumn("__place", place)
    first = first.select(*names, F.when(F.col("__place") <= F.col("__wanted"), F.col("__place")).cast("long").alias("rank"))
    rest = joined.where(F.col("__score").isNull()).select(*names, F.lit(None).cast("long").alias("rank"))
    return first.unionByName(rest)


def rank_documents(docs: DataFrame, target: DataFrame, how: Resample = Resample()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    narrow = docs.select("doc_id", "text")
    weighed = weigh(narrow, gains(narrow, target, how), how).withColumn("__tie", F.xxhash64("text")).drop("text")
    return draw(weighed, how, tie="__tie").select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, how: Resample = Resample()) -> DataFrame:
    """The drawn documents with all their columns, and the outputs."""
    weighed = weigh(docs, gains(docs, target, how), how).withColumn("__tie", F.xxhash64("text"))
    return draw(weighed, how, tie="__tie").where(F.col("rank").isNotNull()).drop("__tie")
