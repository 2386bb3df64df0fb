"""Connected components of undirected links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())


def _to_least(pairs: DataFrame) -> DataFrame:
    """Of rows (u, v): u, v and m, the least of u and all its v. What is summed up by u is cut, so that the join can split a hub."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): a row (node, component) for each node that has one; the component is its smallest node.

    Each step is a sum by node and a join, both spread over nodes and links; the lineage is cut after each. Loops and
    repeated links don't matter.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = cut(large.where("a <> b").distinct()).select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = _to_least(down)
        edges = cut(
            small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        )
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
