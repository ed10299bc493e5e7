"""N-gram Jaccard join by rare-first prefix filtering, and the groups it links.

Two sets can only reach similarity t if, with all n-grams in one global order,
their first ``n - ceil(t * n) + 1`` n-grams share one. With rare n-grams first
that prefix index holds few common entries. The order needs no exact counts to
give exact results, only to be the same everywhere: documents per n-gram are
counted in a fixed number of counters by hash, over all documents, and n-grams
are ordered by (counter, hash). Filters on length, on position in the order and
on the rest of the sets (their n-grams per hash range) thin the candidates; each
remaining pair is verified once, on whole sets.

Groups of copies do not become all their pairs. Equal sets are one class at
once. An n-gram's documents are first held against one pivot, the smallest
id among them; only documents that are not in one group after that are paired
with each other, whatever their number. Two documents that link are then either
in one group already or a verified pair, so no link is lost.

Defined cases: null and empty texts have no n-grams and link with nothing; a text
of fewer words than n has its whole sequence as its one n-gram; rows that repeat
a doc_id are one document with the links of all its texts, and each row returns
its own ``n_shingles``; rows without a doc_id link with nothing and return a null
component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.llm import words as W
from sparktidy.llm.tables import ddl, hide, show, small_batches
from sparktidy.session import materialize

COUNTERS = 1 << 20  # counters of the global order, 2 MB as it is broadcast
LANES = 64  # counters per row while they are summed
RANGE_BITS = 6  # of the hash ranges in the filter on the rest of the sets
PIVOTS = 3  # that a class is held against before all others
BITS = 1 << 24  # bits of the filter that spares uninvolved texts, 2 MB


@dataclass(frozen=True)
class Jaccard:
    words: int = 5
    percent: int = 80


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct n-gram hashes)`` for each text, A-Z lower-cased."""
    for first, last, raw, offsets in W.slices(texts):
        raw = W.LOWER[raw]
        starts, ends, before = W.cut(raw, offsets)
        words = W.hashes(raw, starts, ends)
        grams = W.windows(words, n)
        for row in range(first, last):
            a, b = before[row - first], before[row - first + 1]
            if b - a >= n:
                yield row, np.unique(grams[a: b - n + 1])
            elif b > a:  # its own kind of hash, so that it meets no whole n-gram
                whole = W.windows(np.concatenate([words[a:b], np.array([b - a], np.uint64)]), int(b - a) + 1)
                yield row, W.mix(whole ^ np.uint64(W.BASE))
            else:
                yield row, np.zeros(0, np.uint64)


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in W.parts(batches):
            found = [s for _, s in sets_of(batch.column(0), n)]
            if found:
                total += np.bincount((np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64),
                                     minlength=COUNTERS)
        lanes = total.reshape(-1, LANES)
        used = np.flatnonzero(lanes.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(lanes[used, i]) for i in range(LANES))],
            ["row", *(f"c{i}" for i in range(LANES))])

    return run


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Documents per counter, on a scale of a sixteenth of a power of two. The
    sums are Spark's; the driver gets the fixed number of counters."""
    lanes = [f"c{i}" for i in range(LANES)]
    summed = docs.select("text").mapInArrow(_count(n), "row long, " + ", ".join(f"{c} long" for c in lanes)).groupBy(
        "row").agg(*[F.sum(c).alias(c) for c in lanes]).toArrow()
    total = np.zeros((COUNTERS // LANES, LANES))
    if summed.num_rows:
        total[summed.column("row").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in lanes], axis=1)
    summed = None
    W.give_back()
    return np.rint(16 * np.log2(1 + total.ravel())).astype(np.uint16)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _ordered(n: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in W.parts(batches):
            sizes, prefixes, spread, marks = [], [], [], []
            for _, own in sets_of(batch.column(1), n):
                by = np.lexsort((own, rank[(own % np.uint64(COUNTERS)).astype(np.int64)]))
                prefix = own[by[: prefix_length(len(own), percent)]] if len(own) else own
                sizes.append(len(own))
                prefixes.append(prefix.view(np.int64))
                spread.append(np.bincount((own >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS))
                with np.errstate(over="ignore"):
                    marks.append((int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0,
                                  int(W.mix(own + np.uint64(W.BASE)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))),
                 pa.array([s.tolist() for s in spread], pa.list_(pa.int32()))],
                ["doc_id", "size", "m1", "m2", "prefix", "spread"])

    return run


def _bits(ids: np.ndarray) -> list[np.ndarray]:
    key = W.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1))
    return [(key >> np.uint64(s)) % np.uint64(BITS) for s in (0, 20, 40)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit field that is set for all ids of a one-column table, eight
    bits a byte. It only thins rows out before an exact join: the fuller, the less
    it spares."""
    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False))))
            bit = np.left_shift(np.uint64(1), at % np.uint64(64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(bit)],
                                             ["at", "bit"])

    words = ids.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(BITS // 64, np.int64)
    field[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    words = None
    W.give_back()
    return field.view(np.uint8)


def _hit(field: np.ndarray, column: pa.Array) -> np.ndarray:
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    hit = ~column.is_null().to_numpy(zero_copy_only=False)
    for at in _bits(ids):
        hit &= (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)
    return hit


def _sets(n: int, field):
    def run(batches):
        for batch in W.parts(batches):
            batch = batch.filter(pa.array(_hit(field.value, batch.column(0))))
            found = [s.view(np.int64) for _, s in sets_of(batch.column(1), n)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["id", "grams"])

    return run


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link and points to one that has none of its own."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not nodes.agg(F.max((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of a link table ``(a, b)``, by turns of
    large-star and small-star steps until all links are stars. Links only get fewer
    and point to smaller ids; the turns are about the logarithm of the longest chain.
    A hub's rows are grouped by minimum before they are shuffled. A step is one join:
    the row that holds a node's minimum stands for the node itself. A large-star step
    has no more rows than links and nodes, so equal ones wait for the small-star step."""
    edges = materialize(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(edges):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias(
            "edge")).select("edge.*")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        edges = materialize(both.join(low, "a").where("b > a OR b = low").select(
            F.greatest("a", "b").alias("a"), F.col("low").alias("b")), "large")
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        edges = materialize(edges.join(low, "a").select(
            F.when(F.col("b") != F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b")).distinct(), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def joined_groups(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """``grouped`` (a result of ``components``) after further links. Only links
    between groups are followed, with each group as one node."""
    for side in "ab":
        own = grouped.select(F.col("node").alias(side), F.col("component").alias("group"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("group", side)).drop("group")
    more = components(links)
    moved = grouped.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(more)


def _enough(percent: int) -> Column:
    """The filters of a candidate pair: lengths, and n-grams per hash range."""
    a, b = F.col("size_a"), F.col("size_b")
    most = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * most >= percent * (a + b))


def _reachable(percent: int) -> Column:
    """Whether an entry may be the first one that two sets share: if so, they can
    share no more than what follows it in either order. Every pair that is
    similar enough has such an entry, and the sizes have to be close."""
    a, b = F.col("size_a"), F.col("size_b")
    most = F.least(a - F.col("place_a"), b - F.col("place_b"))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * most >= percent * (a + b))


class _Join:
    def __init__(self, docs: DataFrame, how: Jaccard):
        self.how, self.spark = how, docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sc = self.spark.sparkContext

    def run(self) -> DataFrame:
        n, percent = self.how.words, self.how.percent
        order = self.sc.broadcast(frequencies(self.docs, n))
        listed = materialize(self.docs.mapInArrow(
            _ordered(n, percent, order),
            "doc_id long, size long, m1 long, m2 long, prefix array<long>, spread array<int>"), "prefixes")
        order.destroy()  # the prefixes are written
        self.nodes = self._classes(listed)
        entries = self._tokens(self._shared(listed))
        best = self._pivot_pairs(entries)
        first = materialize(self._verified(best).select("a", "b"), "verified")
        grouped = materialize(components(first), "groups")
        rest = self._open_pairs(entries, grouped, best)
        second = self._verified(rest).select("a", "b")
        final = joined_groups(grouped, second.unionByName(self._same_id()))
        rows = self.nodes.join(final, self.nodes["class"] == final["node"], "left")
        return rows.select("doc_id", F.col("size").alias("n_shingles"),
                           F.coalesce("component", "class").alias("component_id"))

    def _classes(self, listed: DataFrame) -> DataFrame:
        """Every row with its class, the smallest doc_id with the same set."""
        narrow = listed.select("doc_id", "size", "m1", "m2", "spread")
        whole = narrow.where("size > 0 AND doc_id IS NOT NULL").groupBy("size", "m1", "m2").agg(
            F.min("doc_id").alias("class"))
        joined = narrow.join(whole, ["size", "m1", "m2"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
        return materialize(joined.withColumn("class", own).select("doc_id", "class", "size", "spread"), "classes")

    def _same_id(self) -> DataFrame:
        """Rows that share a doc_id but not a class are one document."""
        ids = self.nodes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("class").alias("a"), F.max("class").alias("b"))
        return self.nodes.join(ids.where("a != b").select("doc_id", F.col("a").alias("b")), "doc_id").select(
            F.col("class").alias("a"), "b")

    def _shared(self, listed: DataFrame) -> DataFrame:
        """Prefix entries whose n-gram is in the prefix of another document.
        Counting combines before the shuffle; in the join back Spark may split
        an n-gram that many documents share."""
        entries = listed.where("doc_id IS NOT NULL").select(
            "doc_id", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("place", "gram"))
        # of two sets the smaller one shares an entry this early, or none that matters
        early = (100 + self.how.percent) * (F.col("size") - F.col("place")) >= 2 * self.how.percent * F.col("size")
        common = entries.groupBy("gram").agg(F.count("*").alias("n"), F.max(early).alias("early"))
        return entries.join(common.where("n > 1 AND early").select("gram"), "gram")

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        meta = self.nodes.where("size > 0 AND doc_id = class")
        for side in "ab":
            pairs = pairs.join(meta.select(
                F.col("class").alias(side), F.col("size").alias(f"size_{side}"),
                F.col("spread").alias(f"spread_{side}")), side)
        return pairs.where(_enough(self.how.percent))

    def _pivot_pairs(self, entries: DataFrame) -> DataFrame:
        """Each class with up to ``PIVOTS`` pivots: of each of its shared entries
        the most central class, the one whose own entries are shared most, and
        of those pivots the ones it shares most entries with."""
        common = entries.groupBy("gram").agg(F.count("*").alias("n"))
        weight = entries.join(common, "gram").groupBy("class").agg(F.sum("n").alias("weight"))
        weighed = entries.select("gram", "class").join(weight, "class")
        pivots = weighed.groupBy("gram").agg(F.max(F.struct("weight", -F.col("class"))).alias("top"), F.min("class").alias("lo"),
                                             F.max("class").alias("hi")).where("lo != hi")
        pivots = pivots.select("gram", F.explode(F.array_distinct(F.array(-F.col("top.col2"), "lo"))).alias("class"))
        side = {x: entries.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "size", "place")]) for x in "ab"}
        pivots = side["b"].join(pivots.withColumnRenamed("class", "class_b"), ["gram", "class_b"])
        pairs = side["a"].join(pivots, "gram").where((F.col("class_a") != F.col("class_b")) & _reachable(self.how.percent))
        pairs = pairs.groupBy(F.greatest("class_a", "class_b").alias("a"), F.least("class_a", "class_b").alias("b")).agg(
            F.count("*").alias("shared"))
        best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
        pairs = self._filtered(pairs).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PIVOTS)
        return materialize(pairs.select("a", "b"), "pairs")

    def _tokens(self, shared: DataFrame) -> DataFrame:
        """Shared prefix entries by class, copies merged."""
        classes = self.nodes.where("doc_id IS NOT NULL").select("doc_id", "size", "class").distinct()
        return materialize(shared.join(classes, ["doc_id", "size"]).select(
            "gram", "class", "size", "place").distinct(), "entries")

    def _open_pairs(self, entries: DataFrame, grouped: DataFrame, done: DataFrame) -> DataFrame:
        """Candidate pairs across groups. Of an n-gram whose documents fall into
        several groups, the largest group's documents are only held against the
        others; an n-gram of one group makes no pair at all."""
        placed = entries.join(grouped.withColumnRenamed("node", "class"), "class", "left")
        placed = placed.withColumn("component", F.coalesce("component", "class"))
        split = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed = materialize(placed.join(split.where("lo != hi").select("gram"), "gram"), "mixed")
        main = mixed.groupBy("gram", "component").agg(F.count("*").alias("n")).groupBy("gram").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"))
        mixed = mixed.join(main, "gram")
        side = {s: mixed.select("gram", "main", *[F.col(c).alias(f"{c}_{s}") for c in (
            "class", "size", "place", "component")]) for s in "ab"}
        a, b = side["a"].where("component_a != main"), side["b"].drop("main")
        pairs = a.join(b, "gram").where(
            (F.col("component_a") != F.col("component_b"))
            & ((F.col("component_b") == F.col("main")) | (F.col("class_a") > F.col("class_b")))
            & _reachable(self.how.percent))
        pairs = pairs.select(F.greatest("class_a", "class_b").alias("a"),
                             F.least("class_a", "class_b").alias("b")).distinct()
        done = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return materialize(self._filtered(pairs.join(done, ["a", "b"], "left_anti")).select("a", "b"), "open")

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """Whole sets of the documents in pairs. The bit field spares the n-grams
        of all others; the exact semi-join follows."""
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        field = self.sc.broadcast(id_filter(wanted))
        found = self.docs.mapInArrow(_sets(self.how.words, field), "id long, grams array<long>")
        sets = materialize(found.join(wanted, "id", "left_semi"), "sets")
        field.destroy()
        return sets

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets are similar enough."""
        sets = self._sets_of(pairs)
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("grams").alias(f"grams_{side}")), side)
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        union = F.size("grams_a") + F.size("grams_b") - both
        return pairs.where(100 * both >= self.how.percent * union)


def link_documents(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; see the module's text."""
    return _Join(docs, how).run()


def _further_texts(docs: DataFrame) -> DataFrame | None:
    """Where rows repeat a doc_id with other texts: a key of its own for each text
    but the one of the smallest hash, as ``doc_id, seen, key``; None without any.
    Keys are hashes, drawn again as long as one of them is taken."""
    seen = materialize(docs.select("doc_id", F.xxhash64("text").alias("seen")).where("doc_id IS NOT NULL").distinct(), "seen")
    first = seen.groupBy("doc_id").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi")).where("lo != hi")
    further = materialize(seen.join(first.select("doc_id", "lo"), "doc_id").where("seen != lo").select("doc_id", "seen"), "further")
    if not further.head(1):
        return None
    salt = 0
    while True:
        keyed = further.withColumn("key", F.xxhash64(F.lit(salt), "doc_id", "seen"))
        taken = seen.select(F.col("doc_id").alias("key")).distinct().unionByName(keyed.select("key"))
        if not taken.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").head(1):
            return materialize(keyed, "keyed")
        salt += 1


def keep_one(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with the
    columns it came with. Rows without a doc_id stay. Different texts under one
    doc_id are documents of their own here, in the order of their hashes, so only
    equal or linked texts fall together; of rows with equal id and text the one
    with the smallest hash over its columns stays. Only rows that a bit field of
    the dropped or repeated ids lets through are shuffled; the others stay for
    certain."""
    sc = docs.sparkSession.sparkContext
    hidden, inner = hide(docs)
    names, row = hidden.columns, ddl(hidden)

    def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
        field = sc.broadcast(id_filter(ids))

        def hit(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hit(field.value, batch.column(batch.num_columns - 1)))],
                                                 [*batch.schema.names, "hit"])
            W.give_back()

        return df.mapInArrow(hit, f"{row}, id long, hit boolean")

    small_batches(docs.sparkSession)
    keyed = hidden.withColumn("id", F.col(inner["doc_id"]).cast("long"))
    further = _further_texts(keyed.select(F.col("id").alias("doc_id"), F.col(inner["text"]).alias("text")))
    if further is not None:
        tested = marked(keyed, further.select("doc_id").distinct())
        other = tested.where("hit").withColumn("seen", F.xxhash64(inner["text"])).join(
            further.withColumnRenamed("doc_id", "id"), ["id", "seen"], "left").withColumn("id", F.coalesce("key", "id"))
        keyed = materialize(tested.where("NOT hit").select(*names, "id").unionByName(other.select(*names, "id")), "keyed-texts")
    linked = materialize(link_documents(keyed.select(F.col("id").alias("doc_id"), F.col(inner["text"]).alias("text")), how), "linked")
    if further is None:
        dropped = linked.where("doc_id != component_id").select("doc_id").distinct()
    else:
        ids = linked.where("doc_id IS NOT NULL").distinct().join(
            further.select(F.col("key").alias("further"), F.col("doc_id").alias("own"), "seen"),
            F.col("doc_id") == F.col("further"), "left")
        order = F.struct(F.coalesce("own", "doc_id").alias("own"), F.col("further").isNotNull().alias("later"), "seen", "doc_id")
        stays = ids.groupBy("component_id").agg(F.min(order)["doc_id"].alias("doc_id")).select("doc_id")
        dropped = ids.select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    dropped = materialize(dropped, "dropped")
    repeated = linked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    tested = marked(keyed, materialize(dropped.unionByName(repeated).distinct(), "suspects"))
    hashable = [f.name for f in hidden.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    kept = tested.where("hit").join(dropped.withColumnRenamed("doc_id", "id"), "id", "left_anti").groupBy("id").agg(
        F.min_by(F.struct(*names), F.xxhash64(*hashable)).alias("row")).select("row.*")
    return show(tested.where("NOT hit"), inner).unionByName(show(kept, inner))
