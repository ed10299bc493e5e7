"""Matches of patterns with their places, in DataFrame functions only.

The work a match costs hardly grows with the matches of its text (spans are sorted,
running values taken by blocks), so a page of checksums costs no more a match than a
short note. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

WIDTH_BITS = 7  # running values are worked out within blocks of 2**7
LEVELS = 1  # levels of blocks; across them, a hundredth of the elements, plainly. Each level doubles the expression
CHUNK_BITS = 6  # spans whose stretch of a text is cut out at once


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it
    within other lambda functions (where Spark would repeat it per element)."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each element what ``op`` makes of all elements before it. ``values`` is
    a column or a lambda's variable; ``op`` has to be associative."""
    def merge(a, b):
        return op(a, b)

    if levels == 0:
        return F.transform(values, lambda _, i: F.aggregate(F.slice(values, 1, i), zero, merge))
    width = 1 << WIDTH_BITS
    last = F.shiftright(F.greatest(F.size(values) - 1, F.lit(0)), WIDTH_BITS)
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(values, b * width + 1, width), zero, merge))
    return let(blocks, lambda own: let(running(own, zero, op, levels - 1), lambda ahead: F.transform(
        values, lambda _, i: F.aggregate(F.slice(values, i - i % width + 1, i % width), ahead[F.shiftright(i, WIDTH_BITS)], merge))))


@dataclass(frozen=True)
class Pattern:
    """What to look for: leftmost matches without overlap, the value being the
    given group. Texts that do not hold ``needs`` are not searched further."""

    pattern: str
    group: int = 0
    needs: str | None = None


def matches(text: Column, patterns: list[Pattern], around: int = 0) -> Column:
    """All matches as ``struct<start, kind, end, value>``, in order of their
    pattern's number (``kind``) and place. With ``around`` also up to so many
    characters ``before`` and ``after`` a match, back to the last and up to the
    next match of its pattern. A null text has none."""
    def searched(kind: int, p: Pattern) -> Column:
        found = F.regexp_extract_all(text, F.lit(p.pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(p.pattern), F.lit(p.group)) if p.group else F.lit(None).cast("array<string>")
        test = text.rlike(p.pattern) if p.needs is None else F.contains(text, F.lit(p.needs))
        return F.when(test, F.struct(F.lit(kind).alias("kind"), found.alias("found"), value.alias("value"),
                                     F.split(text, p.pattern, -1).alias("gaps")))

    def placed(x: Column) -> Column:
        step = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.length(g) + F.length(m))
        return let(step, lambda s: let(running(s, F.lit(0), lambda a, b: a + b), lambda ahead: F.transform(
            x["found"], lambda m, i: let(ahead[i] + F.length(x["gaps"][i]), lambda start: one(x, m, i, start)))))

    def one(x: Column, m: Column, i: Column, start: Column) -> Column:
        near = []
        if around:
            near = [F.right(x["gaps"][i], F.lit(around)).alias("before"), F.left(x["gaps"][i + 1], F.lit(around)).alias("after")]
        return F.struct(start.alias("start"), x["kind"].alias("kind"), (start + F.length(m)).alias("end"),
                        F.coalesce(x["value"][i], m).alias("value"), *near)

    found = F.array(*[searched(k, p) for k, p in enumerate(patterns)])
    return F.flatten(F.transform(F.filter(found, lambda x: x.isNotNull()), placed))


def apart(spans: Column, taken: Column) -> Column:
    """The ``spans`` (structs with ``start`` and ``end``) that overlap none of
    ``taken``, sorted by place. Spans of length 0 are not expected."""
    both = F.array_sort(F.concat(
        F.transform(taken, lambda t: F.struct(t["start"].alias("s"), F.lit(0).alias("own"), t["end"].alias("e"), F.lit(-1).alias("i"))),
        F.transform(spans, lambda t, i: F.struct(t["start"].alias("s"), F.lit(1).alias("own"), t["end"].alias("e"), i.alias("i")))))

    def kept(x: Column, given: Column) -> Column:
        ends = F.transform(x, lambda t: F.when(t["own"] == 0, t["e"]).otherwise(F.lit(-1)))
        starts = F.reverse(F.transform(x, lambda t: F.when(t["own"] == 0, t["s"]).otherwise(F.lit(2**31 - 1))))
        return let(ends, lambda e: let(starts, lambda s: let(
            running(e, F.lit(-1), F.greatest), lambda before: let(
                F.reverse(running(s, F.lit(2**31 - 1), F.least)), lambda after: F.transform(
                    F.filter(F.transform(x, lambda t, i: F.struct(
                        t["i"].alias("i"), ((t["own"] == 1) & (before[i] <= t["s"]) & (after[i] >= t["e"])).alias("free"))),
                        lambda t: t["free"]), lambda t: given[t["i"]])))))

    return let(spans, lambda given: let(both, lambda x: kept(x, given)))


def masked(text: Column, ranges: Column, mark: str) -> Column:
    """The text with every range (structs with ``start`` and ``end``) replaced by
    ``mark``; overlapping ranges are replaced as one."""
    ordered = F.array_sort(F.transform(ranges, lambda r: F.struct(r["start"].alias("s"), r["end"].alias("e"))))

    def kept(x: Column) -> Column:
        """The stretches of text that stay, in order."""
        return let(F.transform(x, lambda r: r["e"]), lambda ends: let(
            running(ends, F.lit(0), F.greatest), lambda done: F.concat(
                F.filter(F.transform(x, lambda r, i: F.struct(done[i].alias("s"), r["s"].alias("e"))), lambda r: r["s"] <= r["e"]),
                F.array(F.struct(F.array_max(ends).alias("s"), F.length(text).alias("e"))))))

    def written(pieces: Column) -> Column:
        many = 1 << CHUNK_BITS
        chunks = F.sequence(F.lit(0), F.shiftright(F.size(pieces) - 1, CHUNK_BITS))

        def chunk(own: Column) -> Column:
            first, last = own[0]["s"], F.element_at(own, -1)["e"]
            return let(F.substring(text, first + 1, last - first), lambda t: F.array_join(
                F.transform(own, lambda p: F.substring(t, p["s"] - first + 1, p["e"] - p["s"])), mark))

        return F.array_join(F.transform(chunks, lambda c: let(F.slice(pieces, c * many + 1, many), chunk)), mark)

    return F.when(F.size(ranges) > 0, let(ordered, lambda x: let(kept(x), written))).otherwise(text)
