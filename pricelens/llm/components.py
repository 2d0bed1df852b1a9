"""Connected components by large and small stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def toward_least(pairs: DataFrame, both: bool) -> DataFrame:
    """Each row (u, v) of pairs as (v, least neighbour of u, u included); with both, u as well."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if both:
        ends = F.explode(F.array("v", "u"))
        out = joined.select(ends.alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that each node of links reaches. No links give no rows; loops and repeats are harmless.

    A round's edges are written to the shared folder, so lineage stays short.
    A node of many links is one row of minima and splittable rows of edges.
    """
    edges = saved(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        large = toward_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), both=False)
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = saved(toward_least(oriented, both=True), "links")
