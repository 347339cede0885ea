"""Connected components by alternating star contractions, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisemix.llm.common import drop_written, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest in the node's neighbourhood."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ends = down.join(least, "a").select("m", F.explode(F.array("a", "b")).alias("a"))
    return ends.where("a != m").select("a", F.col("m").alias("b"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node without one."""
    ways = edges.groupBy("a").agg(F.count("*").alias("n"))
    if not ways.where("n > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge; ``edges`` has two columns of one type, ``a`` and ``b``.

    The root is the smallest node of the component.  Rounds grow with the logarithm of a
    component's diameter; each ends in a written table, whose files go once the next one stands.
    No edges give no rows.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down.where("a != b").distinct(), "stars")
    while not _is_stars(now):
        before, now = now, written(_small_star(_large_star(now)).distinct(), "stars")
        drop_written(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
