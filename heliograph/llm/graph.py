"""Connected components by alternating large and small stars on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links; root is the component's smallest node.

    Minima are pre-aggregated and hot nodes meet their edges in plain joins, so no neighbourhood is ever
    gathered. Every round is written, and the rounds end when one changes nothing; stars, chains and
    repeated or self links are all fine.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = written(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        before, edges = edges, written(small.distinct(), "edges")
        drop(before)
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.written_at = edges.written_at
            return out
        seen = state
