"""Connected components by alternating large and small stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no other edge's smaller end: all nodes then know their root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("larger")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count("*").alias("n")).filter("larger > 0 AND n > 1").isEmpty()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs, either way round, repeats allowed);
    the root is the component's smallest node and has a row too. No edges give no rows."""
    stars = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose,
    )
    while not _are_stars(stars):
        stars = written(_small_star(_large_star(stars)), purpose)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
