"""Base spans against Python's regular expressions, trees against plain counts,
added spans on planted texts."""

import hashlib
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sparktidy.llm import boosting, personal

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    return (True, None, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]


def base(text):
    return [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in sorted(
        (m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text or "") if passes(k, m[0]))]


def card(rng, good=True):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    check = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (check if good else str((int(check) + 1) % 10))


def corpus(n=120, seed=3):
    """Texts that hold what the model learns from, one find of each kind a text."""
    rng = random.Random(seed)
    return [(1000 + i, f"Text {i % 9} of {card(rng, i % 3 != 0)} mail x{i}.y@mail{i % 7}.example.com call +1 ({100 + i}) 555-01{i % 90 + 10} "
             f"from 10.{i}.3.{i % 200} in 19{i % 90 + 10}, 12 or {i}.", "s") for i in range(n)]


ODD = [(50, "a@b.c@d.e.f @x.y a@b a@b..c .@q.r --@-.-", "s"), (51, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.0256", "s"),
       (52, "4111 1111 1111 1111 4111-1111-1111-1111x 4111  1111 0000000000000", "s"), (53, "+1 (377) 555-0271 +12345678 +1..23 ++1 2 3456789(", "s"),
       (54, "😀é +49 30 901820 mail é@x.de ü.b@x.de, 10.0.0.1", "s"), (55, "a" * 20_000 + "@" + "b-" * 5000 + ".com", "s")]


def test_base_spans(docs_of, odd_rows, clashing):
    rows = odd_rows + ODD + corpus(40) + [ODD[2]]
    found = personal.scan(clashing(docs_of(rows))).collect()
    assert len(found) == len(rows)
    sha = lambda spans: hashlib.sha256(",".join(spans).encode()).hexdigest()
    wanted = sorted((i, sha(base(t)), len(base(t))) for i, t, _ in rows if i is not None)
    assert sorted((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in found if r.doc_id is not None) == wanted
    for r in found:
        if r.doc_id is not None:
            assert set(base(next(t for i, t, _ in rows if i == r.doc_id))) <= set(r.spans.split(",")) | {""}


def added(rows, found):
    out = {}
    for r in found:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        more = set(r.spans.split(",")) - set(base(text)) - {""}
        out[r.doc_id] = sorted(text[int(s):int(e)] for _, s, e in (x.split(":") for x in more))
        assert r.n_added == len(more)
    return out


def test_added_spans(docs_of):
    rng = random.Random(5)
    a, b, bad = card(rng), card(rng), card(rng, False)
    planted = [(1, f"cards {a} {b} here", "s"), (2, f"call +1 (843) 555-7672 170.106.47.218 now", "s"), (3, f"two {bad} {bad} numbers", "s"),
               (4, "write jane.doe (at) example (dot) org or jim [at] mail.example.com today", "s"),
               (5, "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "s"), (6, f"{a} {bad}", "s"),
               (7, "call (843) 555-7672 or 843-555-7673", "s"), (8, "we met at noon (at) last", "s"), (9, "1 2 3 4 5 6 7 8 9 10 11 12", "s")]
    rows = corpus() + planted
    got = added(rows, personal.scan(docs_of(rows)).collect())
    assert got[1] == sorted([a, b]) and got[6] == [a] and got[2] == ["+1 (843) 555-7672"] and got[3] == []
    assert got[4] == ["jane.doe (at) example (dot) org", "jim [at] mail.example.com"]
    assert got[5] == ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"] and got[8] == got[9] == []
    assert got[7] == ["(843) 555-7672", "843-555-7673"]
    assert all(got[i] == [] for i, _, _ in corpus())


def test_chance_numbers_are_left_alone(docs_of):
    """Where numbers pass the check digit at chance level, glued ones that do are not added."""
    rng = random.Random(8)
    rows = [(i, "id " + "".join(rng.choice("0123456789") for _ in range(16)) + " of a part", "s") for i in range(400)]
    a = card(rng)
    found = personal.scan(docs_of(rows + [(1000, f"ids {a} {a} glued", "s")])).collect()
    assert all(r.n_added == 0 for r in found) and 10 < sum(r.n_card for r in found) < 80


def test_redact(docs_of, clashing, odd_rows):
    rows = corpus(60) + odd_rows
    docs = clashing(docs_of(rows))
    out = personal.redact(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    for i, t, _ in corpus(60):
        want, at = "", 0
        for _, s, e in sorted((x.split(":") for x in base(t)), key=lambda x: int(x[1])):
            want, at = want + t[at:int(s)] + "[PERSONAL]", int(e)
        assert text[i] == want + t[at:]
    assert text[1] is None and text[2] == "" and text[10] == "a b c d e"


def test_long_texts(docs_of):
    rows = [(1, "7" * 200_000, "s"), (2, "1." * 100_000, "s"), (3, "+1 " * 60_000, "s"), (4, "a." * 100_000 + "@", "s"),
            (5, "\n".join(f"host{i} 10.{i % 256}.{i // 256}.9 up" for i in range(8_000)), "s"), (6, "1 2-" * 50_000, "s")]
    start = time.time()
    found = {r.doc_id: r for r in personal.scan(docs_of(rows, 6)).collect()}
    assert time.time() - start < 90
    assert found[5].n_ip == 8_000 and found[2].n_ip == 25_000 and found[1].n_card == found[3].n_phone == found[4].n_email == 0


def test_empty(docs_of):
    assert personal.scan(docs_of([])).count() == 0 and personal.redact(docs_of([])).count() == 0
    assert [tuple(r)[1:] for r in personal.scan(docs_of([(1, None, "s")])).collect()] == [
        (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)]


def test_no_python_on_the_executors(docs_of):
    docs = docs_of(corpus(20))
    plans = [docs.select(personal.proposals(F.col("text"))), personal.scan(docs), personal.redact(docs)]
    assert not any(re.search("Python|Pandas|Arrow", d._jdf.queryExecution().toString()) for d in plans)


def cells(n=200, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    f = np.unique(rng.integers(0, 5, (n, 4)), axis=0)
    odds = (f[:, 0] > 2) * 3.0 - (f[:, 1] <= 1) * 2.0 + (f[:, 2] == 3) * 1.0 - 0.5
    weight = rng.integers(20, 60, len(f)).astype(float)
    true = rng.binomial(weight.astype(int), 1 / (1 + np.exp(-odds)))
    return np.concatenate([f, f]), np.repeat([1.0, 0.0], len(f)), np.concatenate([true, weight - true]).astype(float)


def test_best_split_against_all_splits():
    f, label, weight = cells()
    g, h = weight * (label - 0.4), weight * 0.24
    gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1) + g[~own].sum() ** 2 / (h[~own].sum() + 1)
    every = {(k, v): gain(f[:, k] <= v) for k in range(4) for v in range(4)}
    assert every[boosting.best_split(f, g, h, 1.0)] == max(every.values())
    assert boosting.best_split(f[:1], g[:1], h[:1], 1.0) is None


def test_trees(spark):
    f, label, weight = cells()
    base_odds, trees = boosting.fit(f, label, weight)
    odds = boosting.scores(f, base_odds, trees)
    loss = lambda o: float((weight * np.logaddexp(0, np.where(label > 0, -o, o))).sum() / weight.sum())
    n = len(f) // 2
    share = np.clip(weight[:n] / (weight[:n] + weight[n:]), 1e-9, 1 - 1e-9)
    best = loss(np.tile(np.log(share / (1 - share)), 2))
    assert best < loss(odds) < best + 0.25 * (loss(np.full(len(f), base_odds)) - best)
    table = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(f)], "i int, f array<int>")
    said = {r.i: r.s for r in table.select("i", boosting.score(F.col("f"), base_odds, trees).alias("s")).collect()}
    assert all(math.isclose(said[i], odds[i], abs_tol=1e-9) for i in said)
    assert boosting.fit(f[:0], label[:0], weight[:0]) == (0.0, [])
