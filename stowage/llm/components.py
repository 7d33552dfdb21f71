"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sized, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node (a) and its smaller neighbours (b) are hung below the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Every node of edges (a, b; long) with the least node it reaches: node, root. Self-edges and nulls are left out.

    Large-star and small-star steps alternate, each an aggregation and a join; the edges are written after each pair
    of steps, until they are stars (every node has one smaller neighbour, which has none) and stay so.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges, "stars")
    rows = edges.count()
    while rows:
        edges = written(sized(_small_star(_large_star(edges)), rows), "stars")
        rows = edges.count()
        # stars: no node hangs below two, and no node that others hang below hangs itself
        twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        if sized(twice.select("a").union(chained.select("a")), rows).isEmpty():
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """node, root of a forest (a hangs below b < a, each a once), by doubling the steps towards the root."""
    up = written(parents.select(F.col("a").alias("node"), F.col("b").alias("root")), "forest")
    rows = up.count()
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        stepped = up.join(above, "root", "left").select("node", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved"))
        up = written(sized(stepped, rows), "forest")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return up.select("node", "root").union(up.select(F.col("root").alias("node"), "root").distinct())
