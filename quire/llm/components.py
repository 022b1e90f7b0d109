"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _larger_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _smaller_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the least of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v of one ordered type. Returns node, root (the least node of its component) for nodes with an edge.

    Hubs are safe: groups are reduced to a minimum before they are shuffled, and joins on a hub can be split.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        now = materialize(_smaller_star(_larger_star(now)), "edges")
        if (new := mark(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
