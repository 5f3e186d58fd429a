"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stash


def _least(edges: DataFrame) -> DataFrame:
    """The smallest b of each a; a table of its own, so that Spark can split the
    rows of a hub where edges are joined to it."""
    return stash(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b): the smallest id reachable.

    Rounds of large-star and small-star: every end is linked to its smallest
    neighbour, until each component is a star around its smallest id.  Only
    minima are aggregated, so a hub's links are never gathered."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")
        large = stash(large, "large-star")
        lower = _least(large)
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e"))
        spent = [edges, least, large, lower]
        edges = stash(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        discard(spent)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
