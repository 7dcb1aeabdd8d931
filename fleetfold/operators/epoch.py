"""Epoch alignment, routing by epoch and exact epoch aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.scalars import fixed_sum


def route(epoch: Column | str, current: Column | str) -> Column:
    """deliver in the current epoch, buffer a later one, drop an earlier one."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    c = F.col(current) if isinstance(current, str) else current
    return F.when(e == c, "deliver").when(e > c, "buffer").otherwise("drop")


def contributions(df: DataFrame, value: str, order: str, epoch: str = "epoch",
                  node: str = "node") -> DataFrame:
    """What each node brings into an epoch: its last value there, with weight 1."""
    last = df.groupBy(epoch, node).agg(F.max_by(value, order).alias("value"))
    return last.withColumn("weight", F.lit(1.0))


def epoch_average(parts: DataFrame, epoch: str = "epoch", digits: int | None = None) -> DataFrame:
    """What averaging gossip converges to: total value over total weight."""
    total = F.sum("value") if digits is None else fixed_sum("value", digits)
    return parts.groupBy(epoch).agg(F.try_divide(total, F.sum("weight")).alias("average"))


def epoch_sum(parts: DataFrame, epoch: str = "epoch", digits: int | None = None) -> DataFrame:
    """What push-sum with weight on the root alone converges to."""
    total = F.sum("value") if digits is None else fixed_sum("value", digits)
    return parts.groupBy(epoch).agg(total.alias("total"))


def epoch_count(parts: DataFrame, epoch: str = "epoch") -> DataFrame:
    """What consensus with value 1 everywhere and weight on the root converges to.

    ``parts`` has one row per node and epoch, so counting rows counts nodes.
    """
    return parts.groupBy(epoch).agg(F.count("*").alias("nodes"))


def result_columns(results: DataFrame, keys: tuple[str, ...] = ("epoch", "node")) -> DataFrame:
    """Results (op, value) as columns: avg is ``speed``, sum is ``count``; absent ones are 0.

    A key without any result gives no row.
    """
    def picked(op):
        return F.coalesce(F.max(F.when(F.col("op") == op, F.col("value"))), F.lit(0.0))

    return results.groupBy(*keys).agg(picked("avg").alias("speed"), picked("sum").alias("count"))
