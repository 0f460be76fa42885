"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v, as the large star makes them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, tmp: Scratch | None = None) -> DataFrame:
    """(id, component): every vertex of ``edges(a, b)`` with the smallest vertex it reaches.

    Loops and repeated edges do no harm; an empty edge list has no vertices. Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one round at most; a round replaces
    the one before, and the last one goes with ``tmp``. A hot vertex meets partial minima and joins whose large
    partitions Spark may split, never a collected list.
    """
    tmp = tmp or Scratch(edges.sparkSession, "components")
    now = tmp.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "round 0")
    seen, n = None, 0
    while True:
        n += 1
        now = tmp.written(_small_star(_large_star(now)), f"round {n}")
        tmp.drop(f"round {n - 1}")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
