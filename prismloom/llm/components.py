"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.storage import cut


def _least_star(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the least node about u. Minima are combined before the shuffle, so hubs don't gather."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with an edge to another one; a component is named by its least node.

    Alternates the two star operations of Kiveris and others (2014): nodes hang their larger neighbours, then their
    smaller ones, on the least node they know, until every edge leads to the least node of its
    component. Every round ends in a checkpoint. Nothing but a count and a checksum comes to the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now, before = cut(now), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _least_star(large)
        small = stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct())
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == before or not state[0]:
            break
        before = state
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
