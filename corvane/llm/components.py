"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tasks_for

#: A key that has more than one in so many of all rows is hot. So there are no more hot keys than this, which bounds what is broadcast.
HOT_KEYS = 1000
#: Edges that one task of a round takes at least, so that rounds over few edges write few files.
EDGES_A_TASK = 1 << 17


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join rows to ``keyed``, which has each key once and, in ``count``, how many rows have it; total: all rows.

    The rows of hot keys, HOT_KEYS at most, stay where they are and meet them by a broadcast of that bounded size; the
    others are shuffled, of which no key has more than its share.
    """
    hot = F.col(count) * HOT_KEYS > F.lit(total)
    few = F.broadcast(keyed.where(hot).drop(count))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(keyed.where(~hot).drop(count), key))


def _large(e: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour, itself counted."""
    both = e.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"), F.count("*").alias("n"))
    return join_hot(both, least, "a", "n", 2 * total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Rows of e are (larger, smaller)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_hot(e, least, "a", "n", total).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (a, b) of one orderable type; the result (node, root) has one row for each node that an edge to another node touches, root being the least node of its component.

    Each round is two joins on a node, of which hubs are met by a bounded broadcast, and each join ends in a checkpoint; the
    number of rounds grows with the logarithm of the longest chain. A round has as many tasks as EDGES_A_TASK and the shuffles'
    partitions allow, one without a shuffle if the edges are few. ``most``: about how many edges there are at most, if that
    is known, by which the edges themselves are dealt. Nulls, loops and repeated edges do no harm.
    """
    good = edges.where("a is not null and b is not null and a <> b")
    e = checkpointed(good.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None if most is None else tasks_for(edges.sparkSession, most, EDGES_A_TASK))
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        tasks = -(-now[0] // EDGES_A_TASK)
        star = checkpointed(_large(e.coalesce(tasks), now[0]).coalesce(tasks).distinct())
        e = checkpointed(_small(star.coalesce(tasks), star.count()).coalesce(tasks).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()
