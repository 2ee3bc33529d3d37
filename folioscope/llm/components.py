"""Connected components of a link table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Each node's neighbours (the larger ones, or the smaller ones with itself) move to the least of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def contracted(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars: every node has one edge down at most, and none that has one is pointed at."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; links are rows (a, b), component is the smallest node reachable."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while not contracted(edges):
        edges = stored(star(star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
