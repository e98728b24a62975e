"""Connected components of a distributed edge list by alternating large and small stars.

Each round is two grouped minima with joins, written to the shared folder; nothing is collected but a count and a
checksum. A vertex with very many neighbours is aggregated before the shuffle, but its edges meet in one task for
the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large(e: DataFrame) -> DataFrame:
    near = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    met = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (a, b): root is the smallest id of its component. Loops and repeats are fine."""
    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    told = None
    while True:
        after = materialize(_small(_large(e)), "stars")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(e)
        e = after
        if tuple(state) == told or not state["n"]:
            break
        told = tuple(state)
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
