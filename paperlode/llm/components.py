"""Connected components of links between numbers, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.session import settle


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root): the root is the smallest node of the component.

    Large-star and small-star steps in turn: every node hands its neighbours its smallest
    neighbour, until the links are stars around the roots. A step is a minimum for each node, added
    up before the shuffle, and a join that can be split; nodes without links do not appear. Each
    round is stored in the shared folder. An empty table gives an empty table.
    """
    edges = _settled(links.select("a", "b").filter("a <> b"))
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _settled(large.filter("a <> b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        lowered = down.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        new = _settled(lowered.select("e.a", "e.b").filter("a <> b"))
        if _mark(new) == _mark(edges):
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def _settled(edges: DataFrame) -> DataFrame:
    return settle(edges.distinct(), "links")


def _mark(edges: DataFrame) -> tuple:
    """Row count and sums of hashes: equal for equal sets of links."""
    mark = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
    )
    return tuple(mark.first())
