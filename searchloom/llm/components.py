"""Connected components of a graph of longs, as joins and aggregations.

Alternating large-star and small-star rounds: each node's neighbours are linked
to the least node known, until a round changes nothing.  Every round is written
to the shared folder, so a lost executor costs one round at most.  A hub with
many neighbours is summed before it is sent, and joined by sorted joins that
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import save


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of it and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (the greater end) and its lesser neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(own).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node it is connected with, for every node with an edge to another.

    Loops and repeated edges are allowed; nulls are left out.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v").distinct()
    now, before = save(now, "edges"), None
    while True:
        now = save(_small_star(_large_star(now)), "stars")
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stats == before:
            break
        before = stats
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
