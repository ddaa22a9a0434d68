"""Connected components of a table of links, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b), component being its smallest reachable node.

    Alternating stars (Kiveris et al., 2014): every node points its larger neighbours, then its smaller ones, at its smallest
    neighbour, until nothing changes. Each round is written to the shared folder, so lineage stays short. Links from a node
    to itself or to null are ignored; no links give no rows.
    """
    low, high = F.least("a", "b").cast("long"), F.greatest("a", "b").cast("long")
    edges = links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct()
    edges, seen = materialise(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
