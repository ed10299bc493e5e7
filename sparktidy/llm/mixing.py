"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's shuffled token stream is cut into blocks of equal size. Slot k of
the mix looks at the golden-ratio point ``frac((k + 1) * 0.618...)`` (in whole
numbers, modulo 2**31, so that no rounding grows with k), which falls into one
source's share of [0, 1); the r-th slot of a source takes its block ``r mod blocks``.
Any stretch of the schedule therefore holds every source close to its weight.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; an empty table gives an empty
result; documents that repeat in every column used here share their words
evenly up to the block edge; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparktidy.llm.tables import hide, show
from sparktidy.session import materialize

GOLDEN, PERIOD = 1327217885, 1 << 31  # the ratio of both is the golden one
WORD_GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters of the mix."""

    weights: tuple[int, ...] = (5, 2, 1)  # given to the sources in order, over and over
    most_repeats: int = 3  # a target stops at so many times its source
    block_words: int = 512  # words of a block, less in small sources
    least_blocks: int = 256  # so many blocks a source, if it has as many words
    ranges: int = 4096  # hash ranges of the shuffle order, per source


def word_count(text: Column) -> Column:
    """Number of words, counted by Spark itself."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Targets of all sources, in SQL windows over one narrow row per source.

    With sources ordered by the share at which they reach their cap, those that
    stop are a prefix of that order, so running sums find it: the k-th stops if
    its cap is within its share of what the ones before it leave."""
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ordered = sizes.withColumn("source_no", number.cast("long")).withColumn(
        "weight", F.element_at(weights, (F.col("source_no") % len(mix.weights) + 1).cast("int")))
    ordered = ordered.withColumn("cap", F.col("source_size").cast("double") * mix.most_repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    staged = ordered.select("*", left.alias("left"), open_weight.alias("open_weight"))
    staged = staged.withColumn("stops", F.col("cap") * F.col("open_weight") <= F.col("left") * F.col("weight"))
    first_open = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source_no", "left",
                                                        "open_weight"))).over(whole)
    staged = staged.withColumn("edge", first_open)
    return staged.select(
        "source", "source_no", "source_size",
        F.when(F.col("stops") | (F.col("source_size") == 0), F.col("cap"))
        .otherwise(F.col("edge.left") * F.col("weight") / F.col("edge.open_weight")).alias("target"))


def _shares(targets: DataFrame, mix: Mix) -> DataFrame:
    """Blocks, block size and the interval of the schedule per source."""
    size = F.col("source_size")
    blocks = F.greatest(F.ceil(size / F.lit(mix.block_words)),
                        F.least(F.lit(mix.least_blocks).cast("long"), size)).cast("long")
    t = targets.withColumn("blocks", blocks)
    need = F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / size).otherwise(F.lit(0.0))
    t = t.withColumn("need", need)
    order = Window.orderBy("source_no")
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("upto", F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("all_need", F.sum("need").over(whole))
    low = F.coalesce(F.lag("upto").over(order), F.lit(0.0))
    return t.withColumn("low", F.coalesce(F.try_divide(low, F.col("all_need")), F.lit(0.0))).withColumn(
        "high", F.when(F.col("upto") >= F.col("all_need"), F.lit(1.0)).otherwise(F.col("upto") / F.col("all_need")))


def schedule(shares: DataFrame, spark, mix: Mix) -> DataFrame:
    """How often each block of each source is taken.

    Slots meet sources by cells of [0, 1): as many cells as sources need few,
    so a slot sees the one or two sources of its cell. Slots are ranked within
    (source, run of slots), and earlier runs' counts are added, so that no task
    ranks a whole source."""
    slots, sources = shares.agg(F.sum("need"), F.count("*")).first()
    slots, cells = int(round(slots or 0)), max(1, 4 * (sources or 1))
    run = 1 << 15
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"((id + 1) % {PERIOD}L) * {GOLDEN}L % {PERIOD}L / {PERIOD}D").alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells).cast("long"))
    held = shares.where("need > 0").select(
        "source_no", "blocks", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"),
                             F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("long"))).alias("cell"))
    placed = points.join(held, "cell").where("x >= low AND x < high").select(
        "source_no", "blocks", "slot", F.floor(F.col("slot") / run).alias("run"))
    counts = placed.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["source_no", "run"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # the schedule's error may give a capped source a slot or two beyond its last allowed pass
    ranked = ranked.where(F.col("rank") < F.col("blocks") * mix.most_repeats)
    return ranked.groupBy("source_no", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def mix_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per document.

    The text gives its word count and a hash and is dropped in the first stage.
    Documents are shuffled by hash; positions in the source's token stream come
    from running sums inside (source, hash range) plus the sums of the ranges
    before, so a source with a third of all rows is spread over its ranges."""
    spark = docs.sparkSession
    sized = materialize(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("order")), "sizes")
    ranges = F.shiftrightunsigned("order", 64 - (mix.ranges - 1).bit_length()).cast("int")
    sized = sized.withColumn("range", ranges)
    parts = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    parts = materialize(parts, "ranges")
    shares = materialize(_shares(source_targets(parts.groupBy("source").agg(
        F.sum("range_size").alias("source_size")), mix), mix), "targets")
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("__s"), F.col("range").alias("__r"),
                         F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("before"))
    parts = parts.join(shares, F.col("__s").eqNullSafe(F.col("source"))).select(
        "__s", "__r", "before", "source_no", "source_size", "target", "blocks")
    inner = Window.partitionBy("source", "range").orderBy("order", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("start", start).join(
        parts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    placed = placed.withColumn("start", F.col("start") + F.col("before")).drop("__s", "__r", "before")
    # of a source's blocks the first ``more`` hold one word more than the others
    placed = placed.withColumns({"few": F.expr("if(blocks > 0, source_size div blocks, 0)"),
                                 "more": F.expr("if(blocks > 0, source_size % blocks, 0)")})
    block_of = "if({w} < more * (few + 1), {w} div (few + 1), more + ({w} - more * (few + 1)) div few)"
    edge = "{b} * few + least({b}, more)"
    first, last = block_of.format(w="start"), block_of.format(w="(start + size - 1)")
    pieces = placed.where("size > 0").select(
        "source_no", "start", "size", "few", "more", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    low = F.greatest(F.col("start"), F.expr(edge.format(b="block")))
    high = F.least(F.col("start") + F.col("size"), F.expr(edge.format(b="(block + 1)")))
    pieces = pieces.select("source_no", "start", "block", (high - low).alias("words"))
    taken = pieces.join(schedule(shares, spark, mix), ["source_no", "block"]).groupBy("source_no", "start").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.withColumn("some", F.lit(True))
    return placed.withColumn("some", F.col("size") > 0).join(taken, ["source_no", "start", "some"], "left").select(
        "doc_id", "source", "size", "source_size", "target", "order",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes its words,
    rounded up or down by a hash of the document so that the sums hold."""
    hidden, inner = hide(docs)
    sizes = mix_sizes(docs, mix)
    # rows that repeat in id and text share what was taken of them
    copies = sizes.where("taken > 0").groupBy("doc_id", "order").agg(F.avg(F.col("taken") / F.col("size")).alias("times"))
    part = F.pmod(F.xxhash64(F.lit("round"), "order"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = copies.select("doc_id", "order", F.floor(F.col("times") + part).cast("int").alias("n")).where("n > 0")
    keyed = hidden.withColumn("key", F.xxhash64(inner["doc_id"], inner["text"]))
    found = keyed.join(copies.hint("shuffle_hash"), (F.col("key") == F.col("order"))
                       & F.col(inner["doc_id"]).eqNullSafe(F.col("doc_id")))
    return show(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), inner)
