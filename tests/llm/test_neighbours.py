"""Search by learned partitions against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from sparktidy.llm import neighbours as nn

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


@pytest.fixture
def vectors_of(spark):
    return lambda rows, parts=3: spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS).repartition(parts)


def brute(rows, every, k=10):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            best = {}
            for j, v in fine:
                if j != i:
                    best[j] = min(best.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
            out[i] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def found_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: [(v, s) for _, v, s in sorted(rows)] for i, rows in out.items()}


def recall(found, wanted):
    return np.mean([len({j for j, _ in found.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in wanted.items()])


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_scores(vectors_of, clusters):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(max(clusters, 1), 16)) * (3 if clusters else 0)
    rows = [(i, (centers[i % len(centers)] + draw.normal(size=16)).tolist()) for i in range(1500)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    wanted, by_id = brute(rows, 20), dict(rows)
    found = found_of(nn.search(vectors_of(rows), nn.Index(sample=900, rows=200, queries=16), every=20))
    assert set(found) == set(wanted) and recall(found, wanted) >= 0.9
    for i, own in found.items():
        assert len(own) == 10 and own == sorted(own, key=lambda x: (x[1], x[0]))
        for j, s in own:
            assert s == pytest.approx(np.linalg.norm(np.array(by_id[i]) - np.array(by_id[j])), rel=1e-12)


def test_clusters_spare_partitions():
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(16, 16)) * 5
    points = centers[np.arange(2000) % 16] + draw.normal(size=(2000, 16))
    router = nn.Router(points, 16, nn.Index())
    assert np.mean([len(v) for v in router.visits(points[:300])]) < 6


def test_parts_are_balanced_and_follow_the_graph():
    draw = np.random.default_rng(5)
    points = np.repeat(draw.normal(size=(8, 6)) * 20, 50, axis=0) + draw.normal(size=(400, 6))
    graph = nn.nearest(points, points, 8)
    part = nn.cut_graph(graph, 8, draw)
    assert set(np.bincount(part).tolist()) == {50}
    assert np.mean(part[graph] == part[:, None]) > 0.8


def test_ties_repeats_and_unusable_rows(vectors_of):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 60)] + [(100, [1.0, 0.0, 0.1]), (200, [1.0, 0.0, 0.0])]
    rows += [(200, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0]),
             (600, [1.0, None, 0.0]), (700, [float("inf"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (800, []), (900, [1.0, 2.0]),
             (-100, [0.0, 5.0, 0.0]), (0, [0.0, 0.0, 9.0])]
    found = found_of(nn.search(vectors_of(rows), nn.Index(rows=8, queries=2)))
    same = [r for r in rows if r[0] != 900]  # a vector of another length takes no part
    wanted = brute(same, 100)
    assert {i: [j for j, _ in own] for i, own in found.items()} == {i: [j for j, _ in own] for i, own in wanted.items()}


def test_few_candidates(vectors_of):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (100, [5.0, 5.0])]
    found = found_of(nn.search(vectors_of(rows)))
    assert {i: [j for j, _ in own] for i, own in found.items()} == {0: [1, 100], 100: [0, 1]}  # both others are as far from 100: the smaller id is first
    assert nn.search(vectors_of([])).count() == 0 and nn.search(vectors_of([(0, None)])).count() == 0
    assert nn.search(vectors_of([(0, [1.0])])).count() == 0
