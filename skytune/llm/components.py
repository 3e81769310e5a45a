"""Connected components of links between 64-bit ids, as Spark joins.

Alternating large-star and small-star steps: each step points the neighbours
of a node at the smallest one among them.  A node's neighbours are never
gathered (a minimum per node and a join), so a node that holds a third of all
links is an ordinary skewed join.  Each round is written to the shared folder,
which also cuts the lineage; only its change counter reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour."""
    n = _both_ways(e)
    low = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return n.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest."""
    d = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = d.groupBy("a").agg(F.min("b").alias("m"))
    moved = d.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: every id that has a link, and
    the smallest id it is connected with."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if not state["n"] or state == before:
            break
        before = state
        e = stored(_small_star(_large_star(e)))
    # stars now: every a points at its component's smallest id
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
