"""Running declared queries on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.operators.epoch import route
from fleetfold.operators.messages import concat_sources, drop_canaries, drop_null_records, for_query, unwrap
from fleetfold.operators.reduce import merges
from fleetfold.plans.spec import MapReduceQuery, run_tagged
from fleetfold.streaming.in_order import SLOTS, as_of_in_order


def event_time(stream: DataFrame, time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Makes ``time`` a zoned timestamp, which watermarks require, and sets the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed(query: MapReduceQuery, stream: DataFrame, window: str = "10 seconds", time: str = "ts",
             delay: str = "1 minute") -> DataFrame:
    """A declared query in tumbling windows of a stream."""
    return query.run_windowed(event_time(stream, time, delay), window, time)


def multi_windowed(queries: Sequence[MapReduceQuery], stream: DataFrame, window: str = "10 seconds",
                   time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Several declared queries over one reading of a stream, told apart by their id."""
    return run_tagged(queries, event_time(stream, time, delay), window, time)


def two_level(query: MapReduceQuery, routed: DataFrame, window: str = "10 seconds", time: str = "ts",
              head: str = "head") -> DataFrame:
    """A declared query in tumbling windows, reduced at each cluster head first and then over all heads.

    ``routed`` has a watermark on ``time``. Both reductions keep state and run in one stream in append mode: a window leaves
    the first level, with its end as event time, when the watermark passes it, and the second level thereafter.
    ``heads`` is the number of heads that reported on a key.
    """
    at_head = query.mapped(routed, [time, head]).groupBy(F.window(time, window), head, "key").agg(*query.aggregates())
    span = F.window(F.window_time("window"), window)
    whole = at_head.groupBy(span, "key").agg(*merges(query.reduce, digits=query.digits), F.count(F.lit(1)).alias("heads"))
    return whole.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                        *[c for c in whole.columns if c != "window"])


def enveloped(query_uid: str, sources: Mapping[str, DataFrame], key_type: str, value_type: str,
              observation: str | None = None) -> DataFrame:
    """One query's records from several streams of enveloped messages: typed, with ``ts``, their time of creation.

    Probes, records without a value and records of other queries are left out; ``observation`` names
    the count of records whose key and value are tagged differently.
    """
    raw = concat_sources(sources)
    typed = unwrap(raw, key_type, value_type)
    own = for_query(drop_null_records(drop_canaries(typed)), query_uid, observation=observation)
    return own.select("key", "value", F.timestamp_millis("created_ms").alias("ts"))


def first_status(sends: DataFrame, statuses: DataFrame, message: str = "uuid", status: str = "status", order: str = "seq",
                 time: str = "ts", bound: str = "1 hour", delay: str = "1 minute", window: str = "1 hour") -> DataFrame:
    """Each message of a stream with the first status reported for it within ``bound`` of its sending, else null.

    The stream form of ``operators.messages.first_status``: an outer join of both streams, bounded in time on either side, so that
    state is forgotten; then one reduction per message, which takes the earliest status by time and ``order`` and ignores later
    and repeated ones. Both sides have a time column ``time``. A message leaves when the watermark has passed it by
    ``bound`` and its window of ``window``. Append only.
    """
    sent, told = _both(sends, statuses, message, time, delay)
    joined = sent.join(told, _within(message, time, bound), "left_outer")
    first = joined.groupBy(F.window(time, window), message).agg(
        F.min_by(status, F.when(F.col("_at").isNotNull(), F.struct("_at", order))).alias(status))
    return first.select(message, status)


def stray_statuses(sends: DataFrame, statuses: DataFrame, message: str = "uuid", time: str = "ts", bound: str = "1 hour",
                   delay: str = "1 minute") -> DataFrame:
    """Statuses of a stream that belong to no message: of unknown ones, too early, or later than ``bound`` after the sending."""
    sent, told = _both(sends, statuses, message, time, delay)
    joined = told.join(sent.select(message, time), _within(message, time, bound), "left_outer").where(F.col(time).isNull())
    return joined.select(F.col("_of").alias(message), F.col("_at").alias(time),
                         *[c for c in statuses.columns if c not in (message, time)])


def _both(sends: DataFrame, statuses: DataFrame, message: str, time: str, delay: str) -> tuple[DataFrame, DataFrame]:
    told = event_time(statuses.where(F.col(message).isNotNull()), time, delay)
    return event_time(sends, time, delay), told.withColumnsRenamed({message: "_of", time: "_at"})


def _within(message: str, time: str, bound: str) -> Column:
    return ((F.col(message) == F.col("_of")) & (F.col("_at") >= F.col(time))
            & (F.col("_at") <= F.col(time) + F.expr(f"INTERVAL {bound}")))


def route_epochs(messages: DataFrame, epochs: DataFrame, delay: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """Messages of a stream with ``current``, their node's epoch at their time, and ``route``: deliver, buffer or drop.

    ``messages`` is (node, at, epoch, ...) and ``epochs`` (node, at, epoch): from ``at`` on this is the node's epoch. Before its first
    epoch a node buffers. Neither side's arrival order matters within ``delay``.
    """
    starts = epochs.where("epoch is not null").withColumnRenamed("epoch", "current")
    known = as_of_in_order(messages, starts, "node", "at", "at", "current", delay, slots)
    return known.withColumn("route", F.when(F.col("current").isNull(), "buffer").otherwise(route("epoch", "current")))
