"""Connected components of a graph of longs, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _least(edges: DataFrame, value) -> DataFrame:
    """edges with m, the value of each u; a u may have any number of rows, which are dealt by v too."""
    edges = edges.withColumn("salt", scratch.salt("v"))
    least = edges.groupBy("u").agg(value.alias("m"), scratch.salts("v").alias("salts"))
    return edges.join(least.select("u", "m", scratch.each_salt("salts").alias("salt")), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), F.min("v"))
    moved = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (u, v); component is the least node reachable.

    Each round reads and writes tables in the shared folder, and nothing but two sums reaches the driver. The rounds grow
    with the logarithm of the longest path. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, now
        now = scratch.table(_small_star(_large_star(before)), "edges")
        scratch.drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
