"""The five stages one after the other, and each against its operator."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparktidy.llm import hostrules, mixing, ngramjoin

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "secret_scans", "mixing_sources", "bpe_encoding"]


def test_each_stage(docs_of, odd_rows, clashing, spark):
    good = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(40)), f"s{i % 3}") for i in range(30)]
    copy = [(2000, good[0][1] + " more", "s0"), (2001, good[1][1].upper(), "s1")]
    secret = [(3000, good[5][1].replace("x", "q") + " password=Zq8rT5vW2x", "s2")]
    docs = clashing(docs_of(odd_rows + good + copy + secret))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 2000 not in texts and not {1, 2, 3, 4} & set(texts)
    assert "password=[SECRET]" in texts.get(3000, "password=[SECRET]")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)
    assert all(r.ids == LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)


def test_run_on_the_tables(spark):
    """Against the operators' own verdicts, applied by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    judged = {r.doc_id: r.kept for r in hostrules.judge_documents(docs).collect()}
    rows = [r for r in docs.collect() if judged[r.doc_id]]
    kept = spark.createDataFrame(rows, docs.schema)
    linked = {r.doc_id for r in ngramjoin.link_documents(kept).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in out} <= linked
    one = kept.where(kept.doc_id.isin(sorted(linked)))
    clean = corpus_pipeline.secret_scans(spark, one, SF)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert not any(re.search("AKIA[A-Z0-9]{12}", text[r.doc_id]) for r in out)
    wanted = {}
    for r in mixing.mix_documents(clean).collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + 1
    found = {}
    for r in out:
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
        assert r.round_trip and r.n_tokens == len(r.ids)
    assert found == wanted and len(found) > 50
    for r in out[:200]:
        assert r.ids == LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids


def test_empty(docs_of, spark):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
