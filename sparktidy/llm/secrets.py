"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in the whole text. Every candidate value is hashed, and
the hashes are counted over the corpus by distinct repositories (here: documents
of a source) and distinct owners (sources). A value that more than two owners hold
is a widely copied example, unless nine tenths of the repositories that hold it are
one owner's: then the others have copied that owner's credential. A value that is
no example is taken as live if a base pattern finds it and it is no placeholder, or
if it looks random. Both measures are ratios or owners, so a verdict does not turn
with the number of documents alone.

Defined cases: a null text is empty and has no spans (their digest is that of the
empty string); a null owner is an owner of its own; repeated rows each get their
result; an empty table gives an empty result; further columns are not read by
``scan`` and are kept by ``redact``. Work is linear in a text's matches, however
long the text (spans are sorted once).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm.spans import Pattern, apart, let, masked, matches
from sparktidy.llm.tables import hide, show
from sparktidy.session import materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOOSE = r"[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
#: An assignment's value has eight characters or more; shorter ones match as well, as they use up their text.
PATTERNS = [Pattern(ASSIGN, 1), Pattern(ACCESS, needs="AKIA"), Pattern(HEX), Pattern(LOOSE)]


@dataclass(frozen=True)
class Ownership:
    """When a value counts as somebody's own."""

    most_owners: int = 2
    main_share: float = 0.9  # share of its repositories that makes one owner's value the owner's, whoever else holds it
    least_distinct: int = 8  # different characters of a loose value that looks random


def candidates(text: Column) -> Column:
    """Base spans and, where they touch no base span, loose ones. Each pattern
    runs once, and only the texts it is in are worked on further."""
    def sorted_out(x: Column) -> Column:
        base = F.filter(x, lambda s: F.when(s["kind"] == 0, F.length(s["value"]) >= 8).otherwise(s["kind"] < 3))
        loose = F.filter(x, lambda s: (s["kind"] == 3) & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
                         & s["value"].rlike("[0-9]"))
        return let(F.struct(base.alias("base"), loose.alias("loose")), lambda y: F.when(
            F.size(y["loose"]) == 0, y["base"]).otherwise(F.concat(y["base"], apart(y["loose"], y["base"]))))

    return let(matches(F.coalesce(text, F.lit("")), PATTERNS), lambda x: F.when(F.size(x) == 0, x).otherwise(sorted_out(x)))


def looks_live(value: Column, kind: Column, own: Ownership = Ownership()) -> Column:
    """No placeholder; a loose value also has letters and digits mixed, and enough
    different characters. The word ``password`` itself is a placeholder."""
    random = (value.rlike("[0-9]") & value.rlike("[A-Za-z]")
              & (F.size(F.array_distinct(F.split(value, ""))) >= own.least_distinct))
    return ((kind < 3) | random) & ~F.lower(value).rlike("example|changeme|placeholder|your_|^password$")


def ownership(spans: DataFrame, own: Ownership = Ownership()) -> DataFrame:
    """Per value hash: distinct owners and repositories, verdict. Pairs are made
    distinct before the count, so a value in a third of all documents is spread
    over its documents first and over its owners next."""
    pairs = spans.groupBy("hash", "owner", "repository").agg(F.max("live").alias("live"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("live").alias("live"))
    counted = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                         F.max("repositories").alias("most"), F.max("live").alias("live"))
    example = (F.col("owners") > own.most_owners) & (F.col("most") < F.col("repositories") * own.main_share)
    return counted.select("hash", "owners", "repositories",
                          F.when(example, "example").when(F.col("live"), "live").otherwise("dull").alias("verdict"))


def _scanned(docs: DataFrame, own: Ownership, inner: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows with their spans, written once: patterns run once over each text.
    Values are hashed; ``from`` is where a span's value starts."""
    text = F.col(inner["text"])
    hashed = F.transform(candidates(text), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        (s["end"] - F.length(s["value"])).alias("from"), F.sha2(s["value"], 256).alias("hash"),
        looks_live(s["value"], s["kind"], own).alias("live")))
    return materialize(docs.select(*keep, F.col(inner["doc_id"]).alias("id"), F.col(inner["source"]).alias("owner"),
                                   F.xxhash64(text).alias("seen"), hashed.alias("spans")), "spans")


def _judged(scanned: DataFrame, own: Ownership) -> DataFrame:
    """One row per document with spans: ``found``, its spans with their verdicts.
    Only spans are shuffled. Rows that repeat in id, owner and text share it."""
    spans = scanned.where(F.size("spans") > 0).select(
        "id", "owner", "seen", F.explode("spans").alias("span")).select("id", "owner", "seen", "span.*")
    verdicts = ownership(spans.withColumn("repository", F.col("id")), own)
    found = spans.join(verdicts, "hash").groupBy(
        F.col("id").alias("__id"), F.col("owner").alias("__owner"), F.col("seen").alias("__seen")).agg(
        F.collect_set(F.struct("start", "kind", "end", "from", "verdict", "owners", "repositories")).alias("found"))
    same = (F.col("seen") == F.col("__seen")) & F.col("id").eqNullSafe(F.col("__id")) & F.col("owner").eqNullSafe(
        F.col("__owner"))
    return scanned.join(found, same, "left")


def scan(docs: DataFrame, own: Ownership = Ownership()) -> DataFrame:
    """Counts, base digest and all spans per document, and for each span how many
    owners and repositories hold its value (``held_by``)."""
    names = {c: c for c in ("doc_id", "text", "source")}
    judged = _judged(_scanned(docs.select(*names), own, names, []), own)
    nothing = F.array().cast("array<struct<start:int,kind:int,`end`:int,from:int,verdict:string,owners:bigint,repositories:bigint>>")
    found = F.filter(F.array_sort(F.coalesce(F.col("found"), nothing)),
                     lambda s: (s["kind"] < 3) | (s["verdict"] == "live"))
    judged = judged.withColumn("found", found)
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] < 3)
    held_by = F.array_join(F.transform("found", lambda s: F.concat_ws(
        ":", s["owners"].cast("string"), s["repositories"].cast("string"))), ",")

    def number(field: str, wanted) -> Column:
        return F.size(F.filter("found", lambda s: s[field] == F.lit(wanted))).cast("long")

    counts = [number("kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    verdict = [number("verdict", v).alias(f"n_{v}") for v in ("live", "example")]
    return judged.select(F.col("id").alias("doc_id"), *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"),
                         listed(F.col("found")).alias("spans"), counts[3], *verdict, held_by.alias("held_by"))


def redact(docs: DataFrame, own: Ownership = Ownership(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with the value of every live span replaced by ``mark`` where
    it stands, and ``n_chars`` set anew where that column exists. Widely copied
    examples stay. Texts are scanned once and written once with their spans; those
    without a candidate go straight through, only the others are shuffled."""
    hidden, inner = hide(docs)
    scanned = _scanned(hidden, own, inner, list(inner.values()))
    clean = scanned.where(F.size("spans") == 0)
    live = F.filter("found", lambda s: s["verdict"] == "live")
    held = _judged(scanned.where(F.size("spans") > 0), own).withColumn("live", F.transform(
        live, lambda s: F.struct(s["from"].alias("start"), s["end"].alias("end"))))
    text = F.col(inner["text"])
    held = held.withColumn(inner["text"], masked(text, F.col("live"), mark))
    if "n_chars" in inner:
        held = held.withColumn(inner["n_chars"], F.length(text).cast("long"))
    return show(clean, inner).unionByName(show(held, inner))
