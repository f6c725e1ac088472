"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, text_or_empty

#: Leading hexadecimal digits of a document's place in the shuffled order that the histogram tells apart.
DIGITS = 3
#: Sources up to which their targets are broadcast; beyond, they are joined by a shuffle that Spark splits where it is skewed.
BROADCAST_SOURCES = 100_000


def seeded_order(seed: int) -> F.Column:
    """A document's place in the shuffled order, by its id or, where it has none, by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty().cast("binary")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))


def size_of(text: str = "text") -> F.Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, total: F.Column, cap: float) -> DataFrame:
    """sources: (source, source_size, weight). Adds target.

    The level is what a unit of weight gets. Sources above ``cap`` times their size are clamped there and the
    excess goes to the others by weight, until no source is above. Each round is one small aggregate, of which
    one row comes to the driver; a round clamps every source that is above at once, so a handful of rounds do.
    """
    limit = F.lit(cap) * F.col("source_size")
    state = sources.withColumn("clamped", F.lit(False))
    aim = sources.agg(total.alias("t")).first()["t"] or 0.0
    level, clamped = 0.0, -1
    while True:
        row = state.agg(F.sum(F.when(F.col("clamped"), limit)).alias("used"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w"), F.count_if("clamped").alias("n")).first()
        if row["n"] == clamped or not row["w"]:
            break
        clamped = row["n"]
        level = (aim - (row["used"] or 0.0)) / row["w"]
        # Clamping goes by the level: a clamped source stays above, as the level only rises.
        state = sources.withColumn("clamped", F.lit(level) * F.col("weight") > limit)
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > limit, limit).otherwise(F.lit(level) * F.col("weight")))


def plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: the columns (doc_id, source, size, source_size, target, copies).

    Sources, in code point order with null last, have ``weights`` in turn. The mix has ``share`` times the words
    of all documents; a source has ``cap`` times its own at most. A source with a target of r times its words has
    all its documents floor(r) times, and once more the first ones of a seeded order, as long as the middle of the
    document is below the words that the fraction still asks for; so a source misses its target by half a
    document's words at most, and no document is taken more than ceil(r) times.

    Equal rows are separate documents. Null texts and texts without words have size 0 and are taken floor(r)
    times. An empty table gives an empty result. Other columns of ``docs`` are left out.
    """
    sized = docs.select("doc_id", "source", size_of().alias("size"), seeded_order(seed).alias("_order"))
    return with_copies(sized, weights, share, cap)


def with_copies(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sized: (doc_id, source, size, _order, ...). No source is gathered in one task: a histogram over the first digits of the order finds where the fraction ends, and only documents of that one bin are ranked."""
    bins = checkpointed(sized.groupBy("source", F.substring("_order", 1, DIGITS).alias("_bin")).agg(F.sum("size").alias("_n")))
    totals = bins.groupBy("source").agg(F.sum("_n").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = checkpointed(totals.withColumn("weight", weight))
    targets = water_fill(sources, F.lit(share) * F.sum("source_size"), cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio).cast("long")
    targets = targets.select("source", "source_size", "target", whole.alias("_whole"), (F.col("target") - whole * F.col("source_size")).alias("_more"))
    w = Window.partitionBy("source").orderBy("_bin")
    edge = bins.withColumn("_below", F.sum("_n").over(w) - F.col("_n"))
    targets = targets.withColumnRenamed("source", "_s")
    edge = edge.join(targets.select("_s", "_more"), F.col("source").eqNullSafe(F.col("_s")))
    edge = edge.where((F.col("_below") < F.col("_more")) & (F.col("_below") + F.col("_n") >= F.col("_more")) & (F.col("_n") > 0))
    edge = edge.select(F.col("source").alias("_t"), F.col("_bin").alias("_edge"), "_below")
    targets = targets.join(edge, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    targets = checkpointed(targets)
    small = targets.count() <= BROADCAST_SOURCES
    at = sized.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    bin_ = F.substring("_order", 1, DIGITS)
    on_edge = at.where(F.coalesce(bin_ == F.col("_edge"), F.lit(False)))
    w = Window.partitionBy("source").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_below") + F.sum("size").over(w) - F.col("size") / 2
    on_edge = on_edge.withColumn("copies", F.col("_whole") + F.when(middle < F.col("_more"), 1).otherwise(0))
    off_edge = at.where(~F.coalesce(bin_ == F.col("_edge"), F.lit(False)))
    # Without an edge the fraction is nothing, or everything.
    before = F.when(F.col("_edge").isNotNull(), bin_ < F.col("_edge")).otherwise(F.col("_more") >= F.col("source_size"))
    off_edge = off_edge.withColumn("copies", F.col("_whole") + F.when(before & (F.col("_more") > 0), 1).otherwise(0))
    return on_edge.unionByName(off_edge).drop("_order", "_whole", "_more", "_edge", "_below")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``plan`` says. Where only some of several rows with one id are taken, those of fewer words are."""
    columns = docs.columns
    rest = [F.col(c).alias(f"_c_{c}") for c in columns if c not in ("doc_id", "source")]
    sized = docs.select("doc_id", "source", size_of().alias("size"), seeded_order(seed).alias("_order"), *rest)
    taken = with_copies(sized, weights, share, cap)
    out = taken.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(c) if c in ("doc_id", "source") else F.col(f"_c_{c}").alias(c) for c in columns))
