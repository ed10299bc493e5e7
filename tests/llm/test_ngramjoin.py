"""The similarity join against all pairs, on small corpora."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparktidy.llm import ngramjoin, words

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=5):
    own = WORD.findall((text or "").translate(FOLD))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)])


def groups(rows, percent=80):
    """``{(doc_id, size): component}`` by comparing all pairs of rows."""
    sets = [(i, shingles(t)) for i, t, _ in rows]
    near = {i: {i} for i, _ in sets if i is not None}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
                near[j].add(i)
    out = {}
    for start in sorted(near):
        todo, seen = [start], {start}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[start] = min(seen)
    return sorted(((i, len(s), out.get(i)) for i, s in sets), key=str)


def corpus(seed, n=120, vocabulary=4000):
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(vocabulary)}"
    base = [[word() for _ in range(draw.randrange(1, 120))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        own = list(draw.choice(base))
        for _ in range(draw.randrange(0, 6)):
            at = draw.randrange(len(own))
            own[at: at + draw.randrange(0, 2)] = [word()] * draw.randrange(0, 3)
            own = own or [word()]
        if draw.random() < 0.3:
            own += passage
        if draw.random() < 0.2:
            own = [w.upper() for w in own]
        rows.append((i * 7 % 1000, draw.choice([" ", "\n", "  "]).join(own), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs_of, seed):
    rows = corpus(seed)
    found = ngramjoin.link_documents(docs_of(rows)).collect()
    assert sorted(map(tuple, found), key=str) == groups(rows)


def test_odd_rows(docs_of, odd_rows, clashing):
    rows = odd_rows + [(30, "p q", "a"), (31, "P  Q", "a"), (32, "p q r", "a"), (33, "", "a"), (30, "other text", "z"),
                       (34, "OTHER text", "b")]
    found = ngramjoin.link_documents(clashing(docs_of(rows))).select("doc_id", "n_shingles", "component_id").collect()
    wanted = groups(rows)
    joined = {30: 30, 31: 30, 34: 30}  # 30 stands for both of its texts
    wanted = sorted(((i, n, joined.get(i, c)) for i, n, c in wanted), key=str)
    assert sorted(map(tuple, found), key=str) == wanted


def test_border_of_the_limit(docs_of):
    """Overlaps just at, above and below four fifths."""
    base = [f"b{i}" for i in range(49)]  # 45 n-grams
    rows = [(1, " ".join(base), "s")]
    for k in range(1, 14):
        rows.append((100 + k, " ".join(base[:-k] + [f"n{k}x{i}" for i in range(k)]), "s"))
        rows.append((200 + k, " ".join(base + [f"t{k}x{i}" for i in range(k)]), "s"))
    found = ngramjoin.link_documents(docs_of(rows)).collect()
    assert sorted(map(tuple, found), key=str) == groups(rows)


def test_chain_and_hub(docs_of):
    """A chain links neighbours only; a hub links leaves that are no neighbours."""
    line = [f"c{i}" for i in range(400)]
    rows = [(1000 + i, " ".join(line[4 * i: 4 * i + 60]), "s") for i in range(60)]
    hub = [f"h{i}" for i in range(204)]
    rows += [(5, " ".join(hub), "s")]
    for i in range(25):
        own = list(hub)
        for j in range(4):
            own[(7 * i + 50 * j) % 204] = f"leaf{i}x{j}"
        rows.append((2000 - i, " ".join(own), "s"))
    found = ngramjoin.link_documents(docs_of(rows)).collect()
    assert sorted(map(tuple, found), key=str) == groups(rows)


def test_large_group_makes_few_pairs(docs_of, spark):
    draw = random.Random(9)
    base = [f"g{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        own[draw.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(own), "s"))
    join = ngramjoin._Join(docs_of(rows), ngramjoin.Jaccard())
    assert {r.component_id for r in join.run().collect()} == {0}


def test_keep_one(docs_of, clashing):
    rows = corpus(4, 60) + [(2000, "alone in the world we are five", "s"), (2000, "alone in the world we are five", "s"),
                            (None, "alone in the world we are five", "s"), (2001, None, "s"), (2002, "", None)]
    docs = clashing(docs_of(rows))
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {i for i, _, c in groups(rows) if i is not None and i == c}
    found = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in found if i is not None) == sorted(wanted) and found.count(None) == 1


def test_keep_one_of_reused_ids(docs_of, clashing):
    words = [" ".join(f"t{k}w{j}" for j in range(40)) for k in range(6)]
    rows = [(7, words[0], "a"), (7, words[1], "b"), (7, words[1] + " more", "c"), (7, words[2], "d"), (3, words[2], "e"),
            (9, words[3], "f"), (9, words[3], "g"), (9, words[3] + " more", "h"), (9, words[4], "i"), (11, words[4], "j"),
            (12, None, "k"), (12, "", "l"), (12, words[5], "m"), (None, words[5], "n")]
    found = []
    for parts in (1, 3, 7):
        out = ngramjoin.keep_one(clashing(docs_of(rows, parts))).collect()
        found.append(sorted(((r.doc_id, r.text, r.source) for r in out), key=str))
    assert found[0] == found[1] == found[2]
    kept = [(i, t) for i, t, _ in found[0]]
    assert len(set(kept)) == len(kept) == 9
    assert {(7, words[0]), (3, words[2]), (9, words[4]), (12, None), (12, ""), (12, words[5]), (None, words[5])} <= set(kept)
    assert (7, words[2]) not in kept and (11, words[4]) not in kept
    assert sum(i == 7 and t.startswith(words[1]) for i, t in kept) == sum(i == 9 and t.startswith(words[3]) for i, t in kept) == 1


def test_empty(docs_of):
    assert ngramjoin.link_documents(docs_of([])).count() == 0 and ngramjoin.keep_one(docs_of([])).count() == 0
    only = ngramjoin.link_documents(docs_of([(1, None, "a"), (2, "", "b")])).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (503, 501), (900, 900), (7, 3)]
    found = {r.node: r.component for r in ngramjoin.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 201)} == {0} and found[503] == found[501] == 500 and 900 not in found


def _smallest(links):
    """``{node: smallest node of its component}`` for all but the smallest ones."""
    group = {}
    for a, b in links:
        group.setdefault(a, {a})
        group.setdefault(b, {b})
        both = group[a] | group[b]
        group.update(dict.fromkeys(both, both))
    return {x: min(g) for x, g in group.items() if x != min(g)}


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)]
    links += [(1000, i) for i in range(1001, 1200)] + [(1500, i) for i in range(1150, 1300)] + links[:9]
    frame = spark.createDataFrame(links, "a long, b long")
    found = ngramjoin.components(frame).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == _smallest(links)
    first, later = frame.where("pmod(a + b, 3) > 0"), frame.where("pmod(a + b, 3) = 0")
    found = ngramjoin.joined_groups(ngramjoin.components(first), later).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == _smallest(links)


def test_stars_take_no_turn(spark, monkeypatch):
    """What is grouped already is not written again, and a turn writes two tables."""
    written, write = [], ngramjoin.materialize
    monkeypatch.setattr(ngramjoin, "materialize", lambda df, purpose: (written.append(purpose), write(df, purpose))[1])
    for links, tables in (([], []), ([(3, 1), (1, 2), (9, 7), (4, 4)], []), ([(1, 2), (2, 3)], ["large", "small"])):
        written.clear()
        found = {r.node: r.component for r in ngramjoin.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert written == ["links", *tables] and found == _smallest(links)


def test_bit_field(spark):
    ids = [0, 1, -1, 2**62, -2**63, *range(100, 5000, 7)]
    field = ngramjoin.id_filter(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert field.nbytes == ngramjoin.BITS // 8
    assert ngramjoin._hit(field, pa.array([*ids, None])).tolist() == [True] * len(ids) + [False]
    assert ngramjoin._hit(field, pa.array(range(10_000, 20_000))).sum() < 100
    assert not ngramjoin.id_filter(spark.createDataFrame([], "id long")).any()


def test_word_arrays():
    texts = ["a bb  ccc", None, "", " x\ty\x0bz\n", "é üx y", "last"]
    for first, last, raw, offsets in words.slices(pa.array(texts)):
        starts, ends, before = words.cut(raw, offsets)
        own = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
        assert own == [w for t in texts for w in WORD.findall(t or "")]
        assert np.diff(before).tolist() == [len(WORD.findall(t or "")) for t in texts]
        hashes = words.hashes(raw, starts, ends)
        assert len(set(hashes.tolist())) == len(set(own))


def test_slices_and_long_words(monkeypatch):
    monkeypatch.setattr(words, "SLICE_BYTES", 10)
    texts = ["abc def", "x" * 50 + " y", None, "q", "abc"]
    seen = []
    for first, last, raw, offsets in words.slices(pa.array(texts).slice(1)):
        starts, ends, _ = words.cut(raw, offsets)
        seen += [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    assert seen == ["x" * 50, "y", "q", "abc"]


def test_hashes_tell_words_apart():
    own = [f"word{i % 977}x{i}" for i in range(60_000)] + ["a" * n for n in range(1, 300)] + ["ab" * n for n in range(1, 200)]
    for _, _, raw, offsets in words.slices(pa.array([" ".join(own)])):
        starts, ends, _ = words.cut(raw, offsets)
        found = words.hashes(raw, starts, ends)
        assert len(np.unique(found)) == len(set(own))
        assert len(np.unique(words.windows(found, 5))) == len(found) - 4
