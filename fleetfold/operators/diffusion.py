"""Diffusion averaging over tables of exchanges, one distributed step per round.

State rows are (node, value, weight), one per node. A round is one join and one
aggregation that use the state once, so plans grow linearly; every few rounds
the state is written to the shared folder to cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.scalars import safe_quotient
from fleetfold.session import cut_lineage

CUT_EVERY = 8


def push_sum(state: DataFrame, sends: DataFrame, rounds: int, cut_every: int = CUT_EVERY) -> DataFrame:
    """Each sender keeps half of value and weight and its receiver adds the other half.

    ``sends`` is (round, src, dst, ok) with one send per node and round. A send
    that is not ok changes nothing. Total value and weight are conserved.
    """
    for number in range(rounds):
        out = sends.where((F.col("round") == number) & F.col("ok")).select(
            F.col("src").alias("node"), "dst")
        half = [(F.col(c) / 2.0).alias(c) for c in ("value", "weight")]
        kept = F.array(F.struct("node", "value", "weight"))
        split = F.array(F.struct("node", *half), F.struct(F.col("dst").alias("node"), *half))
        moved = state.join(out, "node", "left").select(
            F.inline(F.when(F.col("dst").isNull(), kept).otherwise(split)))
        state = moved.groupBy("node").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
        if (number + 1) % cut_every == 0 and number + 1 < rounds:
            state = cut_lineage(state, "push-sum")
    return state.withColumn("estimate", F.try_divide("value", "weight"))


def consensus(state: DataFrame, pairs: DataFrame, rounds: int, cut_every: int = CUT_EVERY) -> DataFrame:
    """Both partners of a session take the mean of their values and of their weights.

    ``pairs`` is (round, a, b, ok), a node in one pair per round at most. An
    aborted session leaves both unchanged. A session is a group of two rows.
    """
    for number in range(rounds):
        live = pairs.where((F.col("round") == number) & F.col("ok"))
        member = live.select(F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("a").alias("lead")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("lead")))))
        met = state.join(member, "node", "left").withColumn(
            "session", F.struct(F.col("lead").isNotNull().alias("paired"), F.coalesce("lead", "node").alias("id")))
        joint = met.groupBy("session").agg(
            F.min("node").alias("low"), F.max("node").alias("high"),
            F.avg("value").alias("value"), F.avg("weight").alias("weight"))
        state = joint.select(
            F.explode(F.array_distinct(F.array("low", "high"))).alias("node"), "value", "weight")
        if (number + 1) % cut_every == 0 and number + 1 < rounds:
            state = cut_lineage(state, "consensus")
    return state.withColumn("estimate", safe_quotient("value", "weight"))
