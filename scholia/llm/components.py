"""Connected components of links, as rounds of joins over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): minima per node and
    joins only, so that a node with many links is never gathered; each round is stored, and
    the rounds end when one leaves the edges as they were.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
        small = large.join(lower, "u").select(ends.alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        current = stored(small.where("u <> v").distinct(), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tree = current.groupBy("u").agg(F.min("v").alias("v"))
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
