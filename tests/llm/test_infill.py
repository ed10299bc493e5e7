"""Rearranged texts against a plain cut in Python, and exact round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparktidy.llm import infill

MARKS = ("<P>", "<S>", "<M>")
ROWS = [(20, "a\nb\nc", "a"), (21, "a\nb\nc\n", "a"), (22, "\n\n\n", "b"), (23, "has <S> inside\nx\n", "b"), (24, "$1 \\ $2\r\n\x85x y\n", "c"),
        (25, "😀\nü\n中文", "c"), (26, "ends in <P\n>S>\n<\nM>", "c"), (27, "x\n" * 60_000, "d"), (28, "y" * 300_000 + "\n" + "z" * 300_000, "d")]


def plain(doc_id, text, rate=100, share=50, seed="7"):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < share else f"<P>{p}<S>{s}<M>{m}"
    return len(lines), "spm" if h[3] % 100 < share else "psm", len(p), len(m), out


@pytest.mark.parametrize("fill", [infill.Infill(), infill.Infill(seed="x", rate=40, suffix_first=0)])
def test_against_plain_cuts(docs_of, odd_rows, clashing, fill):
    rows = [*odd_rows, *ROWS, *((i, "\n".join("abcdefg"[: i % 7]) * (i % 3), "s") for i in range(100, 300))]
    docs = clashing(docs_of(rows)).withColumns({"n": F.lit("x"), "form": F.lit(1), "whole": F.lit(2)})
    out = infill.rearrange(docs, fill)
    assert set(out.columns) == set(docs.columns) | set(infill.OUT)
    found = out.select("doc_id", *infill.OUT, infill.restored(F.col("output"), F.col("form"), fill).alias("back"),
                       "text").collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted(
        ((i, *plain(i, t, fill.rate, fill.suffix_first, fill.seed)) for i, t, _ in rows), key=key)
    assert all(r.back == (r.text or "") for r in found)
    assert {r.form for r in found} == ({"plain", "psm", "spm"} if fill.suffix_first else {"plain", "psm"})


def test_digests(docs_of, odd_rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in infill.digests(docs_of(odd_rows + ROWS)).collect():
        if r.doc_id not in (None, 4):
            text = next(t for i, t, _ in odd_rows + ROWS if i == r.doc_id)
            n, form, p, m, out = plain(r.doc_id, text)
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
                n, form, p, m, sha(out), sha(text or ""))


def test_other_marks_and_units(docs_of):
    fill = infill.Infill(prefix="[a.", suffix="(b$1", middle="\\c", unit=r"[^,%]*+[,%]|[^,%]++")
    docs = docs_of([(i, "one,two%three, four" * (i % 5), "s") for i in range(60)])
    out = infill.rearrange(docs, fill)
    assert out.where(infill.restored(F.col("output"), F.col("form"), fill) != F.col("text")).count() == 0
    assert {r.n for r in out.collect()} == {0, 4, 7, 10, 13}
    with pytest.raises(ValueError):
        infill.rearrange(docs, infill.Infill(prefix="<P>", suffix="<P>x"))


def test_empty_and_plan(docs_of):
    assert infill.digests(docs_of([])).count() == 0
    plan = infill.rearrange(docs_of(ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
