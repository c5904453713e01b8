"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settled


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, bigint).

    ``component`` is the smallest node that can be reached. Alternates the
    large-star and small-star steps, which need about log(n) rounds; a hub's
    neighbours are joined with one row, so Spark can split them. Nothing but
    whether a round changed any link comes to the driver. Links with a NULL end are left out.
    """
    edges = settled(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    while True:
        before, edges = edges, settled(_small_star(_large_star(edges)))
        # the end: a round that leaves the set of links as it was, told by anti joins, not by a digest
        if edges.join(before, ["a", "b"], "left_anti").isEmpty() and before.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
