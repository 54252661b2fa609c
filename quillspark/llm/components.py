"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges of a task: small graphs, and what is left of large ones, need few.
TASK = 200_000


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node's neighbours (large: the greater, else the smaller ones) linked to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.coalesce(tasks)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").coalesce(tasks).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of edges (u, v: one orderable type).

    The number of rounds grows with the logarithm of the longest path.  Each round is cut off by a
    checkpoint, and runs in as many tasks as its edges need; only counts and hash sums reach the driver.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        tasks = -(-seen[0] // TASK)
        now = cut(_stars(_stars(now, True, tasks), False, tasks).coalesce(tasks))
        found = mark(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
