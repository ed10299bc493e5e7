"""Quality rules judged by host.

Every document is held against rules; failures are counted by host, the host's
failure rates are shrunk towards the rate of all hosts by an empirical beta
prior, and the verdict on the host goes back to its documents.

Defined cases: a null text has no words and fails the word rule; a null host is
a host of its own; an empty table gives an empty result; repeated rows are
judged (and counted) one by one; other columns of the input pass through
``keep_documents`` and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm import words as W
from sparktidy.llm.tables import ddl, hide, show, small_batches
from sparktidy.session import materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


@dataclass(frozen=True)
class Limits:
    """Limits of the rules, all in whole numbers so that no rounding decides."""

    min_words: int = 20
    repeat_pct: int = 30  # words in repeated windows
    symbol_pct: int = 10  # symbols per word
    line_pct: int = 50  # repeated lines
    upper_pct: int = 60  # capitals A-Z among characters of words
    short_chars: int = 2  # mean characters of a word
    long_chars: int = 15
    host_pct: int = 50  # a host whose shrunk failure rate is above goes as a whole


def _repeated(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of eight that occur twice in that text."""
    text = np.repeat(np.arange(len(count)), count)
    marked = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        key = W.windows(words, WINDOW)
        whole = text[: len(key)] == text[WINDOW - 1:]
        at = np.flatnonzero(whole)
        with np.errstate(over="ignore"):
            key = W.mix(key[at] + (text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(W.BASE))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(marked, at[twice], 1)
        np.add.at(marked, at[twice] + WINDOW, -1)
    return np.bincount(text, np.cumsum(marked[:-1]) > 0, len(count)).astype(np.int64)


def _lines(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines, copies = [], []
    for text in texts:
        own = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines.append(len(own))
        copies.append(len(own) - len(set(own)))
    return lines, copies


def count_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts behind the rules for batches whose last column is the text."""
    for batch in W.parts(batches):
        texts = batch.column(batch.num_columns - 1)
        found = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
        for first, last, raw, offsets in W.slices(texts):
            starts, ends, before = W.cut(raw, offsets)
            count = np.diff(before)

            def per_text(flags, offsets=offsets):
                total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
                return np.diff(total[offsets])

            inside = ~W.GAPS[raw] & ((raw & 0xC0) != 0x80)
            found["n_words"][first:last] = count
            found["word_chars"][first:last] = per_text(inside)
            found["n_symbols"][first:last] = per_text(SYMBOLS[raw])
            found["n_upper"][first:last] = per_text((raw >= ord("A")) & (raw <= ord("Z")))
            found["n_repeat_words"][first:last] = _repeated(W.hashes(raw, starts, ends), count)
            found["n_lines"][first:last], found["n_dup_lines"][first:last] = _lines(texts[first:last].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(found[name]) for name in COUNTS)],
            [*batch.schema.names[:-1], *COUNTS])


def rule_columns(limits: Limits) -> dict[str, Column]:
    """One boolean per rule, true where a document fails it."""
    c = F.col
    return {
        "few_words": c("n_words") < limits.min_words,
        "repeated_words": 100 * c("n_repeat_words") > limits.repeat_pct * c("n_words"),
        "symbols": 100 * c("n_symbols") > limits.symbol_pct * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > limits.line_pct * c("n_lines"),
        "capitals": 100 * c("n_upper") > limits.upper_pct * c("word_chars"),
        "word_length": (c("word_chars") < limits.short_chars * c("n_words"))
        | (c("word_chars") > limits.long_chars * c("n_words")),
    }


def any_of(rules: dict[str, Column]) -> Column:
    failed = F.lit(False)
    for name in rules:
        failed = failed | F.coalesce(F.col(name), F.lit(False))
    return failed


def beta_prior(hosts: DataFrame, failed: str, seen: str) -> tuple[float, float]:
    """Prior ``(a, b)`` from the hosts' own counts by moments: their pooled rate
    is its mean, and the spread of their rates beyond chance sets its weight.
    One aggregate over hosts; a single row comes back."""
    rate, n, total = F.col(failed) / F.col(seen), F.col(seen).cast("double"), F.sum(seen).cast("double")
    mean, hosts_n, seen_n, second, square = hosts.where(F.col(seen) > 0).select(
        F.sum(failed) / total, F.count("*"), total, F.sum(n * rate * rate), F.sum(n * n)).first()
    if not seen_n:
        return 1.0, 1.0
    chance = mean * (1 - mean)
    scatter = second - seen_n * mean * mean
    pure = seen_n - square / seen_n
    between = (scatter - (hosts_n - 1) * chance) / pure if hosts_n > 1 and pure > 0 else 0.0
    strength = min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6
    if chance <= 0:
        strength = 1.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return mean * strength, (1 - mean) * strength


def judge_hosts(stats: DataFrame, host: str, rules: list[str], limits: Limits = Limits()) -> DataFrame:
    """One row per host: documents, failures by rule, shrunk failure rate and
    verdict. Counts combine before the shuffle, so a host with a third of all
    documents sends one row per task."""
    hosts = stats.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("host_docs"), *[F.sum(F.col(r).cast("long")).alias(f"host_{r}") for r in rules],
        F.sum(F.col("failed").cast("long")).alias("host_failed"))
    hosts = materialize(hosts, "hosts")
    a, b = beta_prior(hosts, "host_failed", "host_docs")
    rate = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > limits.host_pct / 100)


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                    limits: Limits = Limits()) -> DataFrame:
    """Counts, rule failures and the final ``kept`` per document.

    The text is read once and dropped at once; what follows moves a few numbers
    per document. A document goes if it fails a rule itself or if its host is
    rejected."""
    small_batches(docs.sparkSession)
    rules = rule_columns(limits)
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("__host"), F.col(text).alias("__text"))
    schema = ", ".join([f"doc_id {dict(narrow.dtypes)['doc_id']}", f"__host {dict(narrow.dtypes)['__host']}",
                        *(f"{c} long" for c in COUNTS)])
    stats = narrow.mapInArrow(count_rules, schema).select("*", *[rule.alias(name) for name, rule in rules.items()])
    stats = materialize(stats.withColumn("failed", any_of(rules)), "rules")
    hosts = judge_hosts(stats, "__host", list(rules), limits).select("host", "host_rate", "host_rejected")
    return (stats.join(hosts, F.col("__host").eqNullSafe(F.col("host")), "left")
            .withColumn("base_failed", F.col("few_words") | F.col("repeated_words"))
            .withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))
            .drop("host", "__host"))


def keep_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with the columns they came with. Documents and
    their rule failures are written once; only hosts meet in a shuffle."""
    small_batches(docs.sparkSession)
    rules = rule_columns(limits)
    hidden, inner = hide(docs)
    counted = hidden.withColumn("__text", F.col(inner["text"])).mapInArrow(
        count_rules, f"{ddl(hidden)}, " + ", ".join(f"{c} long" for c in COUNTS))
    flagged = counted.select(*inner.values(), *[rule.alias(name) for name, rule in rules.items()])
    written = materialize(flagged.withColumn("failed", any_of(rules)), "judged")
    host = inner["source"]
    rejected = judge_hosts(written, host, list(rules), limits).where("host_rejected").select("host")
    kept = written.where("NOT failed").join(rejected, F.col(host).eqNullSafe(F.col("host")), "left_anti")
    return show(kept, inner)
