"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvec.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (u > v). large: every node hands its smallest neighbour to the larger ones; small: to the rest."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least, "u").withColumn("m", F.least("u", "m"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        rest = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = rest.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node.

    Each round stores its edges and compares their count and hash with the round before; the driver sees two numbers.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
        edges = materialize(_stars(_stars(edges, large=True), large=False), "stars")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
