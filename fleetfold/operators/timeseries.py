"""Queries over stored reading tables (node, timestamp, reading)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = ["node", "timestamp"]
NODE_BLOCK = 1000


def node_positions(posx: DataFrame, posy: DataFrame, speed: DataFrame) -> DataFrame:
    """Complete readings: rows present in all three tables at the same node and time.

    Both joins use the same keys, so each table is shuffled once at most.
    """
    x = posx.select(*AT, F.col("reading").alias("x"))
    y = posy.select(*AT, F.col("reading").alias("y"))
    s = speed.select(*AT, F.col("reading").alias("speed"))
    return x.join(y, AT).join(s, AT)


def downsample(df: DataFrame, modulus: float, time: str = "timestamp") -> DataFrame:
    """Rows whose time is a multiple of ``modulus`` seconds."""
    return df.where(F.col(time) % F.lit(float(modulus)) == 0)


def for_node(df: DataFrame, node: int, other: bool = False) -> DataFrame:
    """Rows of one node, or of all the others."""
    return df.where(F.col("node") != node if other else F.col("node") == node)


def concurrent_nodes(positions: DataFrame, node: int) -> DataFrame:
    """Other nodes with a complete reading no later than this node's first one."""
    starts = positions.groupBy("node").agg(F.min("timestamp").alias("first"))
    own = for_node(starts, node).agg(F.min("first")).scalar()
    return for_node(starts, node, other=True).where(F.col("first") <= own).select("node")


def node_ids(df: DataFrame) -> DataFrame:
    return df.select("node").distinct()


def first_nodes(df: DataFrame, count: int) -> DataFrame:
    """The smallest ``count`` node ids; each task sends at most that many."""
    return node_ids(df).orderBy("node").limit(count)


def time_range(df: DataFrame, modulus: float) -> DataFrame:
    kept = downsample(df, modulus)
    return kept.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def timing_queue(df: DataFrame, time: str = "timestamp", block: int = NODE_BLOCK) -> DataFrame:
    """Which nodes act at which time, in time order.

    The nodes of one time come in blocks of ids, so an array never holds more
    than ``block`` of them even when every vehicle acts at the same moment.
    """
    blocks = df.groupBy(time, F.expr(f"node div {int(block)}").alias("node_block")).agg(
        F.sort_array(F.collect_set("node")).alias("nodes"))
    return blocks.orderBy(time, "node_block")


def cluster_by_node(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows laid out by (node, timestamp), so file statistics prune node and time lookups."""
    by: list[Column | str] = ["node", "timestamp"]
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return spread.sortWithinPartitions("node", "timestamp")


def head_or_self(df: DataFrame, membership: DataFrame, time: str) -> DataFrame:
    """Cluster head at exactly this time, else the node itself.

    ``membership`` has columns node, ``time`` and head.
    """
    heads = membership.groupBy("node", time).agg(F.max("head").alias("_head"))
    return df.join(heads, ["node", time], "left").withColumn(
        "head", F.coalesce("_head", "node")).drop("_head")
