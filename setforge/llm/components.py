"""Connected components of a link table, by alternating stars: Spark joins and sums only, nothing reaches the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import drop_stored, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links point from the larger to the smaller end."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a and b, self links ignored); root is the smallest node of its component.

    A hot node's links are summed to a minimum before they are shuffled and joined back by a plain equality join,
    which Spark splits where it is skewed. Rounds grow with the logarithm of the longest chain.
    """
    e = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    seen = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(e)))
        drop_stored(e)
        e = now
        state = tuple(e.agg(F.count("*"), print_of).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
