"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sealed


def _sum(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(s or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (or itself). As many rows as edges, in which some may be alike."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return edges.join(least.hint("merge"), F.col("b") == F.col("n")).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these. Edges are (larger, smaller).

    One row for each edge: the smallest neighbour's stands for the node itself.
    Both sides of the join read one exchange.
    """
    dealt = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")
    least = dealt.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    return dealt.join(least.hint("merge"), F.col("a") == F.col("n")).select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) that can reach a smaller one: root is the smallest.

    No edges: no rows. Loops and repeated edges count nothing. A round costs
    four shuffles of the edges that are left; rounds grow with the logarithm of
    the longest path. Every round is written to the shared folder, so that
    lineage stays short and lost executors cost one round; all but the last are deleted at the end.
    """
    with scratch(edges.sparkSession) as keep:
        now = sealed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", keep)
        seen = _sum(now)
        while seen[0]:
            keep.clear()
            now = sealed(_small_star(_large_star(now)), "edges", keep)
            if (then := _sum(now)) == seen:
                break
            seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that it can reach."""
    now = roots(edges)
    return now.union(now.select("root", "root")).distinct()
