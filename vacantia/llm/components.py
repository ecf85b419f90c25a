"""Connected components of a table of links by alternating stars; no component is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import written

MAX_ROUNDS = 60
BROADCAST_LINKS = 300_000  # a node and a number for each link and side, at most


def _to_least(links: DataFrame, above: bool, small: bool) -> DataFrame:
    """Points neighbours of every node at the least of its neighbourhood: those above it, or it and those below."""
    if above:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = near.join(F.broadcast(least) if small else least, "a")
    if above:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.where(F.col("a") != F.col("b"))
    return out if above else out.distinct()


def _settled(now: DataFrame, count: int) -> bool:
    """Whether every node has one link, to a node that has none: then the links are the components."""
    if now.select("a").distinct().count() < count:
        return False
    return now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b: long); the component is its least node.

    Null ends and loops are ignored, repeated links count once.
    """
    ends = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ends.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        count = now.count()
        if _settled(now, count):
            break
        small = count <= BROADCAST_LINKS
        now = written(_to_least(_to_least(now, True, small), False, small), "links")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
