"""Features, gains and ranks against a plain count in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparktidy.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = [(1, "The cat sat on the mat. the CAT sat", "t"), (2, None, "t"), (3, "rare éclair word0x1 9 9 9", "t")]


def runs(text):
    words = WORD.findall((text or "").translate(FOLD))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def plain(rows, target, how):
    s, t = (Counter(bucket(f, how.buckets) for x in texts for f in runs(x)[1]) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(how.scale * math.log(
        (t[b] + 1) * (total_s + how.buckets) / ((s[b] + 1) * (total_t + how.buckets))))
    out = []
    for i, x in rows:
        words, found = runs(x)
        weight = sum(gain(bucket(f, how.buckets)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-how.scale * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= how.least_words), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: how.percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def same(found, wanted):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("how", [importance.Resample(), importance.Resample(buckets=13, percent=60, least_words=3, seed="q")])
def test_against_a_plain_count(docs_of, odd_rows, clashing, how):
    rows = [*odd_rows, *((100 + i, " ".join(f"The{(i * k) % 11} cat's {'é' * (k % 3)} on" for k in range(i % 17)), "s") for i in range(150)),
            (300, "w" * 200 + " " + "x" * 64 + " " + "y" * 63 + " " + "ß" * 90, "s"), (301, " \x7f- ", "s")]
    docs = clashing(docs_of(rows)).withColumns({"n_words": F.lit("x"), "bucket": F.lit(0)})
    found = importance.rank_documents(docs, docs_of(TARGET), how)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(map(tuple, found.collect()), plain([r[:2] for r in rows], [r[1] for r in TARGET], how))


def test_resample_keeps_columns(docs_of, clashing):
    rows = [(i, f"plain filler words number {i} " * 6 + ("the cat sat on the mat " * 9 if i % 4 == 0 else ""), "s") for i in range(80)]
    docs = clashing(docs_of(rows))
    out = importance.resample(docs, docs_of([(1, "the cat sat on the mat " * 50, "t")]))
    assert set(docs.columns) | {"rank"} <= set(out.columns)
    got = out.collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
    assert sum(r.doc_id % 4 == 0 for r in got) >= 10  # a quarter of all, but most of those drawn
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in got)


def test_reruns_and_partitions_agree(docs_of):
    rows = [(i, "same words for all of them " * 5, "s") for i in range(200)]
    first = importance.rank_documents(docs_of(rows, 2), docs_of(TARGET)).collect()
    same(map(tuple, first), map(tuple, importance.rank_documents(docs_of(rows, 9), docs_of(TARGET)).collect()))
    assert sum(r["rank"] is not None for r in first) == 50


def test_empty(docs_of):
    assert importance.rank_documents(docs_of([]), docs_of(TARGET)).count() == 0
    rows = [(1, "a b c " * 30, "s"), (2, None, "s"), (None, "", "s")]
    same(map(tuple, importance.rank_documents(docs_of(rows), docs_of([])).collect()), plain([r[:2] for r in rows], [], importance.Resample()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 é-\nİ中\x7f😀_", max_size=40)), min_size=1, max_size=8))
def test_features(texts):
    for piece in importance.pieces(pa.array(texts, pa.string())):
        n, words, pairs, owner = importance.features(piece, 10_000)
        at = 0
        for i, text in enumerate(piece.to_pylist()):
            own, found = runs(text)
            assert n[i] == len(own)
            assert words[at: at + n[i]].tolist() + pairs[owner == i].tolist() == [bucket(f) for f in found]
            at += n[i]


def test_joined_crc():
    a, b = [b"", b"abc", b"\xff" * 70], [b" ", b" x", b" " + b"y" * 64]
    got = importance.joined_crc(*(np.array(x) for x in (np.array(list(map(zlib.crc32, a)), np.uint32),
                                np.array(list(map(zlib.crc32, b)), np.uint32), list(map(len, b)))))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
