"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, undirected) -> node, root: root is the smallest node that node reaches; only nodes on edges.

    Large star: each node points its larger neighbours to its smallest one. Small
    star: each node points itself and its smaller neighbours to the smallest.
    Both are aggregates and joins over rows of two numbers, so a node with many
    edges is never gathered; each round is written to the shared folder. Rounds
    go on until only stars are left, about the logarithm of the longest path.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a root that has none."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    by = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return by.where("down > 1 OR down = 1 AND up = 1").isEmpty()
