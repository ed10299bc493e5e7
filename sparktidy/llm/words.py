"""Words of whole texts as flat arrays, one slice of documents at a time.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. Those six are single bytes in UTF-8 and never part of
another character, so words are cut on the bytes of an Arrow string column,
without a Python string per word. Each word becomes a 64-bit hash of its bytes;
comparisons below are always within one text or one pair of texts, where two
different words meet the same hash with probability near 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # bytes of text that are cut at once; one longer text is a slice of its own
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP_KEYS = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix finaliser); a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what a task derives from a batch stays small.
    After the last one the worker's free memory goes back to the machine."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Workers outlive their tasks; freed memory that they kept would add up with
    what the next stages need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    steps = np.full(n, BASE, np.uint64)  # kept in 64 whole bits: a float in between would lose the low ones
    steps[0] = 1
    return np.multiply.accumulate(steps)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into slices ``(first, last, bytes, offsets)`` of
    whole texts; ``offsets`` count from the slice's start. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, raw[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the number of words before it
    (one entry more than texts)."""
    inside = ~GAPS[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    opens = inside & ~before[:-1]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    closes = np.empty(len(raw), bool)
    if len(raw):
        closes[:-1] = inside[:-1] & ~inside[1:]
        closes[-1] = inside[-1]
        at = offsets[1:][(offsets[1:] > 0)] - 1
        closes[at] = inside[at]
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: its bytes, each weighed by its place in the word."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(starts):  # some words at a time, so that the arrays per byte stay small
        last = max(first + 1, int(np.searchsorted(total, total[first] + (1 << 18), "right")) - 1)
        own, opens = lengths[first:last], total[first:last] - total[first]
        place = np.arange(total[last] - total[first]) - np.repeat(opens, own)
        with np.errstate(over="ignore"):
            value = BYTE_KEYS[raw[place + np.repeat(starts[first:last], own)]]
            value *= _powers(1 << max(12, int(own.max()).bit_length()))[place]
            out[first:last] = np.add.reduceat(value, opens)
        first = last
    return mix(out ^ lengths.astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; entry i is the run that begins at word i."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += words[k: k + count] * STEP_KEYS[k]
    return mix(total)
