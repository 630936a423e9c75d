"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.tables import written


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _is_star_forest(down: DataFrame) -> bool:
    """Whether each node has one link down and none up, or only links up."""
    ends = down.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(down.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its least node.

    Nodes are longs; null ends are not allowed, self-links and repeats are. Each round is written to the
    shared folder, so no lineage grows; the number of rounds is logarithmic for practical graphs. Joins go
    by node, partial aggregates come first, and a hub's links are on the side that adaptive joins split.
    """
    now = written(_downward(links))
    while not _is_star_forest(now):
        now = written(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
