"""Quality, toxicity and language: what they learn holds on rows they never saw."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktidy.llm import langid, quality, toxicity

SYLLABLES = {"xx": "ka mo tu ri sel dan".split(), "yy": "ää üt sch eich ung öl".split(), "zz": "ción ado que ñe llo ía".split()}


def prose(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw, docs, labels = random.Random(7), [], []
    for i in range(900):
        lang = draw.choice(list(SYLLABLES))
        text, bad, toxic = prose(draw, lang, draw.randrange(20, 80)), draw.random() < 0.25, draw.random() < 0.2
        if bad:
            text = draw.choice([text.upper() + "!!", " ".join(w + "***" for w in text.split()), (text.split()[0] + " ") * 40])
        if toxic:
            words = text.split()
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(["grumbel", "Fizzwit", "blork" + draw.choice("aeiou") * 2]))
            text = " ".join(words)
        docs.append((i, text, lang if i % 11 else None, "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(5000, 1, 1), (None, 0, 1), (3, None, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache(),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache())


def is_held(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


def accuracy(found, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 for r in found) and len(held) > 100
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_quality(corpus):
    docs, labels = corpus
    found = quality.score_documents(docs, labels).collect()
    assert all(r.held_out == is_held(r.doc_id, 5, 0) for r in found)
    assert all(r.predicted == int(r.score >= 0.3) for r in found) and accuracy(found, labels, "quality") > 0.95


def test_toxicity(corpus):
    docs, labels = corpus
    found = toxicity.score_documents(docs, labels).collect()
    assert accuracy(found, labels, "toxic") > 0.95
    hidden = docs.limit(1).select(F.lit(9001).cast("long").alias("doc_id"), F.lit(
        "some plain words grуmbe1 and f1zzwit").alias("text"))
    assert [r.predicted for r in toxicity.score_documents(docs.select("doc_id", "text").unionByName(hidden), labels).where(
        "doc_id = 9001").collect()] == [1]


def test_languages(corpus):
    docs, _ = corpus
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs).collect()
    held = [r for r in found if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == is_held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_learning_ignores_held_out_rows(corpus, spark):
    """Labels of held-out rows may say anything."""
    docs, labels = corpus
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    lied = lied.withColumn("quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for run in (toxicity.score_documents, quality.score_documents):
        scores = [{r.doc_id: round(r.score, 9) for r in run(docs, x).collect()} for x in (labels, lied)]
        assert scores[0] == scores[1]
    moved = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    assert "wrong" not in {r.lang_pred for r in langid.identify(moved).collect()}


def test_odd_rows(corpus, docs_of, odd_rows, clashing):
    docs, labels = corpus
    odd = clashing(docs_of(odd_rows))
    whole = docs.unionByName(odd.select(docs.columns))
    for run in (quality.score_documents, toxicity.score_documents):
        found = run(whole, labels).where("doc_id IS NULL OR doc_id < 11").collect()
        assert len(found) >= len(odd_rows) and all(r.score is not None and 0 <= r.score <= 1 for r in found)
    said = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, langid.learn(docs)).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= said and len(said) >= 10


def test_nothing_to_learn(docs_of, odd_rows, spark):
    docs = docs_of(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.0}
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.score_documents(docs, none).collect())
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(bare).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.score_documents(docs, one).collect())
    for run in (quality.score_documents, toxicity.score_documents):
        assert run(docs_of([]), none).count() == 0
    assert langid.identify(docs_of([])).count() == 0


def test_many_languages(spark, monkeypatch):
    """Hundreds of language values, with small limits on shares, sums and blocks."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"l{n:03d}": ["".join(rng.choice(letters, 5)) for _ in range(12)] for n in range(300)}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang, "s") for i, lang in enumerate(list(words) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect())
    for name, value in (("FEW_LANGUAGES", 10), ("HELD_LANGUAGES", 7)):
        monkeypatch.setattr(langid, name, value)
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-5)  # sums of other lengths round otherwise
    right = sum(lang == said for (_, _, lang, _), (_, said, _) in zip(rows, want))
    assert len(want) == 900 and right > 850


@pytest.mark.parametrize("text, folded", [
    ("L0ser", "ioser"), ("lоser", "ioser"), ("1diot", "idiot"), ("$tup!d", "stupid"), ("café", "cafe"), ("4370598", "4370598"),
    ("word***", "word"), ("s​cum", "scum"), ("ｌｏｓｅｒ", "ioser"), (None, ""), ("wow!!!", "wow")])
def test_fold(text, folded):
    assert toxicity.fold(text).strip() == folded


def test_exceptions_free_their_hits():
    matcher = toxicity.Matcher({" trash ": 3.0, " clow": 2.0}, ["trash can"])
    assert matcher.hits(" trash clown trash can clow ") == {0: 3.0, 6: 2.0, 22: 2.0}


def test_exceptions_are_learned(spark):
    rows = [(f"w{i} trash v{i} u", 1) for i in range(40)] + [(f"the trash can of x{i} y", 0) for i in range(12)]
    rows += [(f"plain a{i} b{i} text", 0) for i in range(200)]
    sample = spark.createDataFrame(rows, "text string, label int")
    how = toxicity.Learning(least_weight=1.0)
    lexicon = toxicity.learn_lexicon(sample, how)
    assert " trash " in lexicon and "trash can" in toxicity.learn_exceptions(sample, lexicon, how)


def test_isotonic():
    x, y = quality.pool(np.arange(5.0), np.array([0.0, 2, 1, 3, 3]), np.array([3.0, 3, 3, 3, 3]))
    assert y.tolist() == sorted(y.tolist()) and np.interp([1, 2], x, y).tolist() == [0.5, 0.5]


def test_random_features_approximate_the_kernel():
    kernel = quality.Kernel(features=20_000)
    n = len(quality.NAMES)
    model = quality.Model(np.zeros(n), np.ones(n), kernel)
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(2, 6, n))
    approx = model.features(a)[:, :-1] @ model.features(b)[:, :-1].T
    exact = np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * kernel.width ** 2))
    assert np.abs(approx - exact).max() < 0.05


def test_profiles_are_sums_of_bound_vectors():
    def vector(gram):
        out = np.ones(langid.SIZE, np.float32)
        for k, c in enumerate(gram):
            out = out * np.roll(langid.letter_vector(c), len(gram) - 1 - k)
        return out

    codes = [0, *map(ord, "abca"), 0, ord("é"), 0]
    grams = [codes[i:i + 3] for i in range(len(codes) - 2) if codes[i + 1]]
    assert np.array_equal(langid.profiles(["Abca É!", None])[0], sum(vector(g) for g in grams))
    assert not langid.profiles(["123 ..", None]).any()
    long_text = prose(random.Random(1), "xx", 3000)
    whole = langid.profiles([long_text])
    langid_block, langid.BLOCK_LETTERS = langid.BLOCK_LETTERS, 1000
    try:
        assert np.array_equal(langid.profiles([long_text]), whole)
    finally:
        langid.BLOCK_LETTERS = langid_block


def test_statistics_of_copies_agree():
    texts = pa.array(["a b a b a b! C#", "", None, "a b a b a b! C#"])
    found = quality.statistics(texts)
    assert np.array_equal(found[0], found[3]) and np.isfinite(found).all()
