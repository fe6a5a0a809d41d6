"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds grow with the logarithm of a component's diameter; this many would do for any that fits a disk.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. edges (u, v) with v < u. A vertex's least neighbour is a grouped minimum, so hubs need no one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs to (id, component): each id that has an edge, with the least id it can reach.

    Null ends and loops are passed over; an empty table gives an empty one. Each pair of rounds is written to the
    shared folder, so that lineage stays short and a lost executor costs one round.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        now = stored(_star(_star(now, True), False), "stars")
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if size == before:
            break
        before = size
    else:
        raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
