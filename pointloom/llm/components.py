"""Connected components by alternating large-star and small-star steps on DataFrames.

Edges stay distributed; a step is a minimum per node (combined before the shuffle) and a join, so
no node's neighbours are ever gathered in one row. Null ends and self-loops link nothing; repeated
edges count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """The smallest of a node and its neighbours in pairs (u, v)."""
    return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_lowest(both), "u").where("v > u and v <> m")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node u (the larger end) and its smaller neighbours link to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_lowest(down), "u")
    pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node on a link; component is the smallest node reachable."""
    edges = cut(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
