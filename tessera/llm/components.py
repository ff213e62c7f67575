"""Connected components of a link table by alternating large-star and small-star rounds.

Rounds only move links (never more than given), so a node with very many links
costs one aggregation entry per link; nothing is collected. They end when all
edges are stars, which is asked of the edges: no round is run only to see that
it changes nothing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star, of edges with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
    down = edges.join(least, "v").select("u", F.col("m").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array(F.col("u"), F.col("v"))).alias("u")  # the node and its neighbour both go to the least neighbour
    return down.join(least, "u").select(ends, F.col("m").alias("v")).filter("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or edges up only: then the edges are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component: smallest node that it reaches) of every node that has a link; ``edges`` has columns u, v."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not _all_stars(edges):
        edges = materialise(_round(edges), "edges")
    return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known``, a result of ``components``, with more links (u, v): only the links between its components take rounds."""
    side = lambda s: known.select(F.col("node").alias(s), F.col("component").alias(f"{s}c"))
    between = links.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    step = components(between)
    moved = known.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = step.join(known, "node", "left_anti")
    return materialise(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), "components")
