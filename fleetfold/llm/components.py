"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import cut_lineage

MAX_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """``links`` has longs ``a`` and ``b``; the result has ``node`` and ``label``.

    The label is the smallest node reachable. Only nodes with a link to another
    node are in the result; null ends and loops are ignored. Every round hooks
    each node's neighbours to its smallest neighbour, first the larger and then
    the smaller ones, so chains shorten to stars in a logarithmic number of
    rounds. A node with any number of links is reduced by a minimum with partial results, and its
    neighbours are never gathered: the minima are a stored table, so the join of a hub's links with its minimum is one that
    adaptive execution broadcasts, or splits over tasks. Every round is written to the shared
    folder, so a lost executor costs a round.
    """
    edges = cut_lineage(_oriented(links.where("a is not null and b is not null and a <> b")), "links")
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(cut_lineage(_large_star(edges), "links")), "links")
        hops = edges.select(F.col("low").alias("high")).distinct().join(edges.select("high").distinct(), "high")
        if hops.isEmpty():
            low = edges.select(F.col("low").alias("node")).distinct().withColumn("label", F.col("node"))
            return edges.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(low)
    raise RuntimeError("components did not settle")


def _oriented(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(edges.select("low", "high"))
    least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    larger = both.where("v > u").join(least, "u")
    return _oriented(larger.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut_lineage(edges.groupBy("high").agg(F.min("low").alias("m")), "least")
    moved = edges.join(least, "high").select(F.col("low").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("high").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(own).where("a <> b"))
