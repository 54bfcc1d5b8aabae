"""Connected components by alternating large-star and small-star steps on a table of edges.

Each step gives every node the least node among its neighbours (a partial aggregation) and joins it back, so the neighbours
of a node are never gathered; the joins are plain equi-joins, whose hot keys adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from alluvia.storage import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): each node that has an edge, but for the least of its component, with that least node.

    ``edges`` has columns u and v of one orderable type; null ends and loops are left out. Ends when an alternation changes nothing."""

    def saved(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        """The written edges, with their number and a sum of their hashes, which are observed while they are written."""
        seen = Observation()
        out = scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), f"{name}-{k}")
        return out, (seen.get["n"], seen.get["sum"])

    e, before = saved(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), 0)
    k = 0
    while before[0]:
        k += 1
        e, after = saved(small_star(large_star(e)), k)
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    return e
