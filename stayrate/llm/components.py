"""Connected components by alternating large-star and small-star joins.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.session import stage


def _directed(edges: DataFrame) -> DataFrame:
    """Each pair once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their whole hashes: equal only for equal sets, but
    for a chance of 2^-64."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """Node and the smallest node it is connected with: (node, root).

    ``edges`` has two comparable columns ``a`` and ``b``; only nodes with an
    edge to another node appear, the root itself does not. Minima are combined
    before they are exchanged, no neighbour list is built, and each round is
    written to the shared folder, so nothing depends on a live executor.
    """
    current = stage(_directed(edges), "links")
    before = _state(current)
    while before[0]:
        current = stage(_directed(_small_star(_directed(_large_star(current)))), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
