"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge to another one.

    A large star links each larger neighbour of a node to the smallest one, a small star the smaller
    ones; both keep components as they are, and the number of rounds grows with the log of their size.
    """
    links = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    sign = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, materialise(small.union(best.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
