"""Fill-in-middle rearrangement by one match of a counted pattern per row.

``regexp_count`` gives a text's number n of units (lines). A hash of the id cuts
it at two of the n + 1 borders, a and b. The row's own pattern then holds the unit
a times and b - a times, each as a possessive group, and the rest::

    \\A((?:unit){a}+)((?:unit){b-a}+)(.*)

so one match captures prefix, middle and suffix, and one replacement writes them in
the order of the form. A possessive group never goes back, so the match takes time
linear in the text and no stack, in however many units.

Defined cases: a null text is empty; an empty text and one that holds a mark stay
as they are (form ``plain``), as do the texts that ``rate`` leaves out; a null id
hashes as an empty one; repeated rows get the same cuts; an empty table gives an
empty result; further columns are kept, but for those named like an output, which
the output replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparktidy.llm.tables import hide

LINE = r"[^\n]*+\n|[^\n]++"
OUT = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Infill:
    """Parameters of the rearrangement."""

    seed: str = "7"
    rate: int = 100  # percent of the texts that are rearranged
    suffix_first: int = 50  # percent of those whose suffix comes first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINE  # a pattern whose matches, left to right, make up any text


def _escaped(mark: str) -> str:
    """A mark as it is meant in a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(mark: str) -> str:
    """A mark as it is meant in a pattern."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in mark)


def _hashes(key: Column, how_many: int) -> list[Column]:
    """The first groups of eight hexadecimal digits of the key's sha256."""
    return [F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long") for i in range(how_many)]


def rearrange(docs: DataFrame, fill: Infill = Infill(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with ``n, form, prefix_chars, middle_chars, output`` after its
    columns. No shuffle."""
    marks = [fill.prefix, fill.suffix, fill.middle]
    if len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b) or not all(marks):
        raise ValueError("the three marks have to differ, and none may lie within another")
    hidden, inner = hide(docs)
    key = F.concat(F.lit(f"{fill.seed}:"), F.coalesce(F.col(inner[doc_id]).cast("string"), F.lit("")))
    whole = F.coalesce(F.col(inner[text]), F.lit(""))
    h1, h2, h3, h4 = _hashes(key, 4)
    counted = hidden.withColumns({
        "whole": whole, "n": F.regexp_count(whole, F.lit(fill.unit)).cast("long"), "h1": h1, "h2": h2, "h3": h3, "h4": h4})
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("whole") == "") | (F.col("h3") % 100 >= fill.rate)
    for mark in marks:
        plain = plain | F.contains("whole", F.lit(mark))
    cut = counted.withColumns({
        "a": F.least(first, second), "b": F.greatest(first, second),
        "form": F.when(plain, "plain").when(F.col("h4") % 100 < fill.suffix_first, "spm").otherwise("psm")})
    pattern = F.format_string(f"(?s)\\A((?:{fill.unit.replace('%', '%%')}){{%d}}+)"
                              f"((?:{fill.unit.replace('%', '%%')}){{%d}}+)(.*)", F.col("a"), F.col("b") - F.col("a"))
    p, s, m = map(_escaped, marks)
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    written = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("whole")).otherwise(
        F.regexp_replace("whole", pattern, order)))
    # no part holds a mark, and marks never overlap, so the three marks found in the output are the ones written
    pieces = F.when(F.col("form") != "plain", F.split("output", "|".join(map(_quoted, marks)), -1))
    found = written.withColumn("pieces", pieces).withColumns({
        "prefix_chars": F.length(F.when(F.col("form") == "psm", F.col("pieces")[1]).otherwise(F.col("pieces")[2])).cast("long"),
        "middle_chars": F.length(F.col("pieces")[3]).cast("long")})
    return found.select(*[F.col(i).alias(name) for name, i in inner.items() if name not in OUT], *OUT)


def restored(output: Column, form: Column, fill: Infill = Infill()) -> Column:
    """The text that a rearranged output came from."""
    p, s, m = map(_quoted, (fill.prefix, fill.suffix, fill.middle))
    psm = F.regexp_replace(output, f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, fill: Infill = Infill()) -> DataFrame:
    """Counts, form and the digests of output and restored text per document."""
    out = rearrange(docs.select("doc_id", "text"), fill)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form"), fill), 256).alias("restored_sha256"))
