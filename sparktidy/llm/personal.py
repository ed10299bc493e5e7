"""Personal data: proposed spans, boosted trees, calibrated thresholds; in
DataFrame functions only.

Base patterns find e-mail and IP addresses, payment cards and phone numbers. A
base match that fails its test (part of an address above 255, check digit, number
of digits) is dropped as a whole, though a number may stand in it next to another
one; and people write addresses and numbers in further ways. So generators propose
more spans, which may overlap: unbroken and grouped card numbers, international
and national phone numbers, addresses spelled with (at) and (dot), IPv6 addresses.

Boosted trees, one set per kind, learn from format and context (never from the tests)
which base matches pass their test: the score of a format is the share of numbers like it that
do, far above chance where they are what they look like, and at chance level where
they are ids or measurements. A proposal has to pass its own kind's test, and its
score has to reach its kind's threshold: on the documents held out from the fit, the
lowest score from which on the wanted share of the passing base matches are real. As
a tenth of all numbers pass the check digit of cards by chance, a share s of passing
numbers means that 1 - 0.1 (1 - s) / (0.9 s) of them are real; the other tests have
no such rate, and there s itself is held against the wanted share. Such proposals
join the base finds unless they overlap one, or another such proposal that starts
before.

Defined cases: a null text is empty and has no spans; repeated rows each get their
result; a kind without base finds among the held-out documents gets no threshold, and
none of its proposals are added; an empty table gives an empty result; further columns
are not read by ``scan`` and are kept by ``redact``. Work is linear in the matches of
a text, however long it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm.boosting import Boost, Tree, fit, score, scores
from sparktidy.llm.spans import Pattern, apart, let, masked, matches, running
from sparktidy.llm.tables import hide, show
from sparktidy.session import materialize

KINDS = ["email", "ip", "card", "phone"]
CHANCE = [0.0, 0.0, 0.1, 0.0]  # share of arbitrary numbers that pass the kind's test
#: The base patterns, in forms that neither go back nor start anew within a run.
BASE = [
    Pattern(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Pattern(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Pattern(r"[0-9](?:[\x20-]?[0-9])++"),
    Pattern(r"\+[0-9][\x20().0-9-]+[0-9]", needs="+"),
]
#: Further proposals, each with its kind.
MORE = [
    (0, Pattern(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[(\[{]at[)\]}]\x20?[a-z0-9-]{1,63}"
                r"(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[a-z0-9-]{1,63}){1,8}")),
    (1, Pattern(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, Pattern(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    (2, Pattern(r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})(?![0-9])")),
    (3, Pattern(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2}(?![0-9])", needs="+")),
    (3, Pattern(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){3}(?![0-9])", needs="+")),
    (3, Pattern(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")),
]
#: Words that announce personal data, looked for shortly before a span.
HINTS = r"(?i)mail|phone|tel\b|tel[.:]|call|mobile|fax|card|visa|contact|account|address|\bip\b"
AROUND = 24
FEATURES = 7  # kind, digits, groups, first character, neighbours left and right, hint: whole numbers below 21


@dataclass(frozen=True)
class Personal:
    """Parameters of the scan."""

    boost: Boost = field(default_factory=Boost)
    precision: float = 0.8  # wanted share of real spans among those that pass, from a threshold on
    folds: int = 5  # one in so many documents is held out to calibrate


def _neighbour(c: Column) -> Column:
    """0 nothing or a gap, 1 other, 2 letter, 3 digit."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^\p{L}"), 2).otherwise(1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: step(a, i)) % 10 == 0


def _small_part(p: Column) -> Column:
    return F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")


def _described(m: Column) -> Column:
    """One proposal, whether it passes its test, and its features."""
    def told(x: Column) -> Column:
        kind, value, n = x["kind"], x["value"], F.length(x["digits"])
        tested = (F.when(kind == 0, value.rlike(r"(?i)[a-z]{2,}$"))
                  .when((kind == 1) & F.contains(value, F.lit(":")), F.lit(True))
                  .when(kind == 1, F.forall(F.split(value, r"\."), _small_part))
                  .when(kind == 2, F.when((n >= 12) & (n <= 19), luhn(x["digits"])).otherwise(False))
                  .otherwise((n >= 9) & (n <= 15)))
        groups = F.size(F.split(value, F.when(kind == 0, r"\.|(?i)dot").otherwise("[^0-9A-Fa-f]+"), -1))
        lead = (F.when(kind == 0, value.rlike("^[A-Za-z0-9]").cast("int")).when(kind == 2, value.rlike("^[3-6]").cast("int"))
                .when(kind == 3, F.when(F.startswith(value, F.lit("+")), 1).when(F.startswith(value, F.lit("(")), 2).otherwise(0))
                .otherwise(0))
        return let(tested, lambda ok: F.struct(
            m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"), m["base"].alias("base"),
            (m["base"] & (ok | (kind == 0))).alias("found"), ok.alias("passes"), F.array(
                kind, F.when(kind == 0, 0).otherwise(F.least(n, F.lit(20))), F.least(groups, F.lit(9)), lead,
                _neighbour(F.right(m["before"], F.lit(1))), _neighbour(F.left(m["after"], F.lit(1))),
                m["before"].rlike(HINTS).cast("int")).alias("f")))

    return let(F.struct(m["kind"].alias("kind"), m["value"].alias("value"), _digits(m["value"]).alias("digits")), told)


def proposals(text: Column) -> Column:
    """Base matches (``base``; those that pass are ``found``) and all further
    proposals, with their features. Each pattern runs once."""
    kinds = F.array(*[F.lit(k) for k in [*range(len(BASE)), *(k for k, _ in MORE)]])
    return F.transform(matches(F.coalesce(text, F.lit("")), [*BASE, *(p for _, p in MORE)], AROUND), lambda m: let(
        F.struct(m["start"].alias("start"), kinds[m["kind"]].alias("kind"), m["end"].alias("end"), m["value"].alias("value"),
                 m["before"].alias("before"), m["after"].alias("after"), (m["kind"] < len(BASE)).alias("base")), _described))


@dataclass(frozen=True)
class Model:
    """Per kind base odds, trees, and the score from which on a proposal is taken."""

    kinds: tuple[tuple[float, list[Tree], float | None], ...]

    def takes(self, f: Column) -> Column:
        taken = F.lit(False)
        for kind, (base, trees, least) in enumerate(self.kinds):
            if least is not None:
                taken = F.when(f[0] == kind, F.round(score(f, base, trees), 9) >= least).otherwise(taken)
        return taken


def learn(scanned: DataFrame, how: Personal = Personal(), doc_id: str = "doc_id", spans: str = "spans") -> Model:
    """The model from a table with proposals. Base matches are counted per cell of
    features, label and fold; there are at most some 300,000 such cells (the product
    of the features' values), whatever the table."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(how.folds)) == 0
    seen = scanned.select(fold.alias("held"), F.explode(spans).alias("s")).where("s.base")
    cells = sorted((r.held, tuple(r.f), r.found, r.n) for r in seen.groupBy(
        "held", F.col("s.f").alias("f"), F.col("s.found").alias("found")).agg(F.count("*").alias("n")).collect())
    held, f, found, n = (np.array([c[k] for c in cells]) for k in range(4))
    f = f.reshape(len(cells), FEATURES).astype(np.int64)
    held, found, n = held.astype(bool), found.astype(float), n.astype(float)
    kinds = []
    for kind, least in enumerate(_least(how.precision, c) for c in CHANCE):
        own, rest = held & (f[:, 0] == kind), ~held & (f[:, 0] == kind)
        base, trees = fit(f[rest], found[rest], n[rest], how.boost)
        steps, at = np.unique(-np.round(scores(f[own], base, trees), 9), return_inverse=True)
        share = np.cumsum(np.bincount(at, (n * found)[own])) / np.maximum(np.cumsum(np.bincount(at, n[own])), 1)
        good = -steps[share >= least]
        kinds.append((base, trees, max(float(good.min()), math.log(least / (1 - least))) if len(good) else None))
    return Model(tuple(kinds))


def _least(precision: float, chance: float) -> float:
    """The share of passing numbers from which on the wanted share of them is real."""
    return precision if not chance else chance / (chance + (1 - precision) * (1 - chance))


def selected(spans: Column, model: Model) -> Column:
    """Base finds and taken proposals (``base`` tells them apart), by place."""
    slim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))

    def leading(more: Column) -> Column:
        """Without those that overlap one that starts before, or there and is longer."""
        ordered = F.array_sort(F.array_distinct(F.transform(more, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))))
        return let(ordered, lambda m: let(F.transform(m, lambda s: s["end"]), lambda ends: let(
            running(ends, F.lit(-1), lambda a, b: F.greatest(a, b)), lambda done: F.transform(
                F.filter(m, lambda s, i: s["start"] >= done[i]), slim))))

    def both(x: Column) -> Column:
        base = F.transform(F.filter(x, lambda s: s["found"]), slim)
        more = F.transform(F.filter(x, lambda s: ~s["base"] & s["passes"] & model.takes(s["f"])), slim)
        return let(F.struct(base.alias("base"), more.alias("more")), lambda y: F.when(F.size(y["more"]) == 0, y["base"]).otherwise(
            F.concat(y["base"], leading(apart(y["more"], y["base"])))))

    return F.array_sort(F.when(F.size(spans) == 0, F.array().cast(
        "array<struct<start:int,kind:int,`end`:int,base:boolean>>")).otherwise(let(spans, both)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, how: Personal = Personal()) -> DataFrame:
    """Counts and digest of the base finds, and all selected spans, per document.
    Texts are read once; nothing but counts of cells is shuffled."""
    scanned = materialize(docs.select("doc_id", proposals(F.col("text")).alias("spans")), "proposals")
    found = scanned.select("doc_id", selected(F.col("spans"), learn(scanned, how)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, how: Personal = Personal(), mark: str = "[PERSONAL]") -> DataFrame:
    """The documents with every selected span replaced by ``mark``, and ``n_chars``
    set anew where that column exists. No shuffle but that of ``learn``."""
    hidden, inner = hide(docs)
    text = F.col(inner["text"])
    scanned = materialize(hidden.withColumn("spans", proposals(text)), "proposals")
    model = learn(scanned, how, inner["doc_id"])
    out = scanned.withColumn("found", selected(F.col("spans"), model))
    out = out.withColumn(inner["text"], masked(text, F.col("found"), mark))
    if "n_chars" in inner:
        out = out.withColumn(inner["n_chars"], F.length(text).cast("long"))
    return show(out, inner)
