"""Quality rules against a plain count of the same things."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparktidy.llm import hostrules

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered)}


def test_counts(docs_of, odd_rows):
    repeated = "a b c d e f g h i " * 5
    rows = odd_rows + [(20, repeated, "a"), (21, "l1 x\nl1 x\n\n \nl2 y\nl1 x", "a"), (22, "### a|b <c> 100% $5", "b"),
                       (23, "A b C d E f G h " + "q " * 7 + "A b C d E f G h", "b")]
    found = hostrules.judge_documents(docs_of(rows)).collect()
    assert len(found) == len(rows)
    wanted = Counter((i, *counts(t).values()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == wanted
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def fine(i):
    return " ".join(f"w{i}x{j}" for j in range(30))


def test_hosts_decide(docs_of):
    rows = [(i, fine(i), "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(39)] + [(200, fine(7), "bad")]
    rows += [(300, "short", "tiny"), (301, fine(8), "tiny"), (302, fine(9), None)]
    found = {r.doc_id: r for r in hostrules.judge_documents(docs_of(rows)).collect()}
    assert found[0].kept and not found[0].host_rejected
    assert found[200].host_rejected and not found[200].kept and not found[200].base_failed
    assert not found[301].host_rejected and found[302].kept  # one failure of two is not evidence enough
    assert found[200].host_rate < 39 / 40 and 0 < found[0].host_rate < 0.1  # both pulled towards the middle


def test_keep_documents(docs_of, odd_rows, clashing):
    rows = odd_rows + [(50, fine(1), "a"), (50, fine(1), "a"), (51, fine(2), None)]
    docs = clashing(docs_of(rows))
    kept = hostrules.keep_documents(docs, hostrules.Limits(host_pct=100))
    assert kept.columns == docs.columns
    judged = hostrules.judge_documents(docs, limits=hostrules.Limits(host_pct=100))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(
        r.doc_id for r in judged.where("kept").collect() if r.doc_id)
    assert [r.doc_id for r in kept.where("doc_id = 50").collect()] == [50, 50]


def test_empty(docs_of, spark):
    assert hostrules.judge_documents(docs_of([])).count() == 0
    assert hostrules.keep_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("rates", [[(5, 100), (5, 100)], [(0, 10), (10, 10)], [(0, 5)]])
def test_prior(spark, rates):
    a, b = hostrules.beta_prior(spark.createDataFrame([(f, n) for f, n in rates], "f long, n long"), "f", "n")
    assert a > 0 and b > 0
    pooled = sum(f for f, _ in rates) / sum(n for _, n in rates)
    assert abs(a / (a + b) - min(max(pooled, 1e-6), 1 - 1e-6)) < 1e-9


def test_spark_side_is_narrow(docs_of):
    plan = hostrules.judge_documents(docs_of([(1, "a b", "s")])).select(F.col("kept"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
