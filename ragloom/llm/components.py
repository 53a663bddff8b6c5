"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.shared import cut, discard


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches), by alternating large-star and small-star steps until nothing changes.

    Each step is one shuffle of the edges and their number never grows, however large a group is. The edges of a step
    are deleted as soon as those of the next are written.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(edges)
        edges = step
        # The sums fall with every step that changes an edge; equal sums mean a fixed point of stars.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("u"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
