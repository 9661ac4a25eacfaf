"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of a node (the larger ones, or the smaller ones and itself) to its least neighbour.

    The least neighbour comes from an aggregation with map-side combination and a join back, so the
    star of a hot node is never gathered.
    """
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = links.join(least, "a")
    if larger:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).toDF("a", "b")
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    edges: columns a and b; loops, repeated edges and nulls are ignored. Each round is written to
    the shared folder; it ends when a round changes nothing, which takes a logarithmic number.
    """
    now = stage(edges.where("a is not null and b is not null and a != b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        large = _stars(_both(now), True)
        small = _stars(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        now = stage(small, "stars")
