"""Connected components by alternating large-star and small-star rounds.

Each round is two minima per node and two joins, written once. Nothing about
nodes or links comes to the driver but one row that tells whether all links
already point from a node straight to the root of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Each upper end has one link, and no upper end is also a lower end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") > 0)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, root): each node that has a link, with the smallest node of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())
