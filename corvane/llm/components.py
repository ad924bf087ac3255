"""Connected components by alternating star contractions; every node ends with the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

def _stars(edges: DataFrame) -> DataFrame:
    """Large stars: each node's larger neighbours move to its smallest one. Small stars: each node and its smaller ones do."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    down = large.groupBy("b").agg(F.min("a").alias("m"))
    moved = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x < y")
    return moved.union(down.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct().toDF("a", "b")


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars: no centre is another star's leaf, and no leaf has two centres."""
    twice = edges.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    chained = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return twice.union(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node of a link but the roots themselves.

    Repeated and reversed links are one, links of a node with itself say nothing, no links give no rows. Rounds go on until the edges
    are stars, which takes the logarithm of the longest chain and can't fail to end: no cap stands in for it."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, before = materialize(edges, "cc-edges"), None
    while True:
        # Equal sums are a hint that costs one pass; only then the exact test is made.
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if seen == before and _settled(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before, edges = seen, materialize(_stars(edges), "cc-edges")
