"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(both: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours."""
    return both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in ``links`` (a, b); the component is its smallest id.

    Large and small stars in turn: every node hangs its larger, then its smaller neighbours on the
    least one near it, until nothing changes. Rounds grow with the logarithm of the size; a node
    with very many neighbours only makes a large key of a join, which Spark can split.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").distinct()  # its shuffle serves both uses
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a"), F.col("least").alias("b")))).alias("e")
        ).select("e.a", "e.b")
        edges = stored(small.filter("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
