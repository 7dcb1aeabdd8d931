"""Two-level reduction through cluster heads, and its traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.scalars import octets
from fleetfold.operators.reduce import aggregates, merge_averages
from fleetfold.operators.scans import as_of, running_total
from fleetfold.streaming.in_order import SLOTS, as_of_in_order, running_total_in_order


def assign_heads(status: DataFrame, membership: DataFrame, time: str = "ts",
                 strategy: str = "auto", bucket: str | float | None = None) -> DataFrame:
    """Adds ``head``: the node's latest known cluster head, else the node itself."""
    routed = as_of(status, membership, "node", time, time, "head", strategy, bucket)
    return routed.withColumn("head", F.coalesce("head", "node"))


def stream_heads(status: DataFrame, membership: DataFrame, time: str = "ts", delay: str = "1 minute",
                 slots: int = SLOTS) -> DataFrame:
    """``assign_heads`` on streams: both sides arrive in any order within ``delay``."""
    routed = as_of_in_order(status, membership, "node", time, time, "head", delay, slots)
    return routed.withColumn("head", F.coalesce("head", "node"))


def per_cluster_reduce(mapped: DataFrame, op: str, by: Sequence[Column | str] = (),
                       digits: int | None = None) -> DataFrame:
    """First level: rows (head, key, value) reduced at each cluster head."""
    return mapped.groupBy("head", *by, "key").agg(*aggregates(op, digits=digits))


def two_level_average(mapped: DataFrame, by: Sequence[Column | str] = (),
                      digits: int | None = None) -> DataFrame:
    """Average per head first, then over all heads; equals the one-level average."""
    return merge_averages(per_cluster_reduce(mapped, "average", by, digits), ["key"], digits)


def relay_bytes(records: DataFrame, relay: str = "relay", key: str = "key", value: str = "value") -> DataFrame:
    """Records and bytes (key plus value) through each relay."""
    return records.groupBy(relay).agg(
        F.count("*").alias("messages"), F.sum(octets(key, value)).alias("bytes"))


def running_bytes(records: DataFrame, relay: str, time: str, ties: Sequence[str] = (),
                  key: str = "key", value: str = "value", bucket: str | float | None = None) -> DataFrame:
    """Bytes of each record and the total through its relay up to and including it."""
    sized = records.withColumn("bytes", octets(key, value))
    return running_total(sized, [relay], time, "bytes", "total_bytes", ties, bucket)


def stream_running_bytes(records: DataFrame, relay: str, time: str, ties: Sequence[str] = (), key: str = "key",
                         value: str = "value", bucket: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """``running_bytes`` of a stream; a row comes out once the watermark has passed its bucket."""
    sized = records.withColumn("bytes", octets(key, value))
    return running_total_in_order(sized, [relay], time, "bytes", "total_bytes", ties, bucket, delay)


def traffic_savings(mapped: DataFrame, op: str, sent: Column, result: Column,
                    by: Sequence[Column | str] = (), digits: int | None = None) -> DataFrame:
    """Bytes per head with everything sent on, against bytes after reducing at the head.

    ``mapped`` has (head, key, value) and what ``sent``, the bytes of a row sent
    as it is, reads. ``result`` is the text of a reduced value. Both sides come
    from one pass over the rows.
    """
    reduced = mapped.groupBy("head", *by, "key").agg(*aggregates(op, digits=digits), F.sum(sent).alias("_sent"))
    both = reduced.groupBy("head").agg(
        F.sum("_sent").alias("raw_bytes"), F.sum(octets("key", result)).alias("reduced_bytes"))
    return both.withColumn("saved_percent", F.round(F.try_divide(
        (F.col("raw_bytes") - F.col("reduced_bytes")) * F.lit(100.0), F.col("raw_bytes").cast("double")), 6))
