"""Targets, blocks and the schedule against plain loops."""

import pytest
from pyspark.sql import functions as F

from sparktidy.llm import mixing

WORDS = 37


def targets(sizes, weights, cap=3):
    """Share by weight; cap; share the excess again, until none is above."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 500, 3], [0, 50, 50], [1, 1, 1, 1, 10_000], [7]])
def test_targets(spark, sizes):
    rows = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, source_size long")
    found = [r.target for r in mixing.source_targets(df, mixing.Mix()).orderBy("source").collect()]
    wanted = targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))])
    assert found == pytest.approx(wanted) and sum(found) == pytest.approx(sum(sizes))


def words(i, n):
    return " ".join(f"t{i}w{j}" for j in range(n))


def corpus():
    rows = [(i, words(i, (i * 31) % 300 + 1), "a" if i % 3 else None) for i in range(300)]
    rows += [(1000 + i, words(i, 20), "b") for i in range(10)] + [(2000 + i, words(i, 700), "Ω") for i in range(40)]
    return rows + [(3000, None, "a"), (3001, "", "b"), (3002, words(1, 40_000), "a")]


def test_mix(docs_of, clashing):
    rows = corpus()
    found = mixing.mix_sizes(clashing(docs_of(rows))).select(
        "doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s) + [None]
    own = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources}
    wanted = dict(zip(sources, targets([own[s] for s in sources], [[5, 2, 1][i % 3] for i in range(len(sources))])))
    for s in sources:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {own[s]}
        assert all(r.target == pytest.approx(wanted[s]) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(wanted[s], rel=0.02, abs=30)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    again = mixing.mix_sizes(docs_of(rows, 7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_schedule_follows_the_golden_ratio(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 9000), ("c", 700)], "source string, source_size long")
    mix = mixing.Mix()
    shares = mixing._shares(mixing.source_targets(sizes, mix), mix).cache()
    told = sorted(shares.collect(), key=lambda r: r.source_no)
    slots = round(sum(r.need for r in told))
    ranks, wanted = {r.source_no: 0 for r in told}, {}
    for k in range(slots):
        x = (k + 1) % mixing.PERIOD * mixing.GOLDEN % mixing.PERIOD / mixing.PERIOD
        own = next(r for r in told if r.low <= x < r.high)
        if ranks[own.source_no] < own.blocks * mix.most_repeats:
            key = own.source_no, ranks[own.source_no] % own.blocks
            wanted[key] = wanted.get(key, 0) + 1
        ranks[own.source_no] += 1
    found = {(r.source_no, r.block): r.times for r in mixing.schedule(shares, spark, mix).collect()}
    assert found == wanted
    for r in told:
        assert abs(ranks[r.source_no] - r.need) < 4


def test_odd_rows(docs_of, odd_rows):
    found = mixing.mix_sizes(docs_of(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert all(r.size == 0 and r.taken == 0 for r in found if r.doc_id in (1, 2, 3))
    assert mixing.mix_sizes(docs_of([])).count() == 0
    none = mixing.mix_sizes(docs_of([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in none] == [(0, 0, 0.0, 0)] * 2


def test_mix_documents(docs_of, clashing):
    docs = clashing(docs_of(corpus()))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    taken = {r.source: r.t for r in mixing.mix_sizes(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    mixed = {r.source: r.t for r in out.groupBy("source").agg(
        F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()}
    assert mixed["Ω"] == pytest.approx(taken["Ω"], rel=0.15) and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixing.mix_documents(docs_of([])).count() == 0
