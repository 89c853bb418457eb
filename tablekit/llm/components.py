"""Connected components of a graph given as links, by alternating large-star and
small-star steps; every step is a join and an aggregate, saved once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    # an order-free digest of the edge set: one row to the driver
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """``links``: columns a, b of one ordered type, a != b, no nulls. Returns
    (a, b): each linked vertex but the least of its component, and that least."""
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = saved(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
