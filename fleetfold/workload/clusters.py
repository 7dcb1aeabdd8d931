"""Reduction at cluster heads and the bytes it saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions.scalars import octets
from fleetfold.operators import cluster
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query, stock
from fleetfold.workload.tables import AVERAGE, MPH_UNITS, check


def _headed(spark, sf_dir):
    return cluster.assign_heads(t.status(spark, sf_dir), t.membership(spark, sf_dir))


def _mapped(spark, sf_dir, keep=()):
    return stock("speed_and_count").mapped(_headed(spark, sf_dir), keep=["head", *keep])


@query("per_cluster_reduce", check(f"""SELECT head, 'speedAndCount' AS key, {AVERAGE} FROM headed
    GROUP BY head""", "headed"))
def per_cluster_reduce(spark, sf_dir):
    return cluster.per_cluster_reduce(_mapped(spark, sf_dir), "average", digits=4)


@query("two_level_speed_avg", check(f"SELECT 'speedAndCount' AS key, {AVERAGE} FROM status"))
def two_level_speed_avg(spark, sf_dir):
    window = F.window("ts", "10 seconds").alias("window")
    return cluster.two_level_average(_mapped(spark, sf_dir, keep=["ts"]), [window], digits=4)


def outputs(spark, sf_dir):
    """What each vehicle's mapper emits: the colour as key, speed and node as text."""
    return t.status(spark, sf_dir).selectExpr(
        "node AS relay", "ts", "event_id", "color AS key", f"concat_ws(',', {MPH_UNITS}, node) AS value")


_OUTPUTS = """outputs AS (SELECT node AS relay, ts, event_id, octet_length(encode(color))
    + octet_length(encode(concat_ws(',', CAST(ROUND(mph * 100) AS BIGINT), node))) AS bytes FROM status)"""


@query("relay_bytes", check("""SELECT relay, COUNT(*) AS messages, CAST(SUM(bytes) AS BIGINT) AS bytes
    FROM outputs GROUP BY relay""", more=_OUTPUTS))
def relay_bytes(spark, sf_dir):
    return cluster.relay_bytes(outputs(spark, sf_dir))


RUNNING_BYTES = check("""SELECT relay, ts, CAST(bytes AS BIGINT) AS bytes,
    CAST(SUM(bytes) OVER (PARTITION BY relay ORDER BY ts, event_id) AS BIGINT) AS total_bytes
    FROM outputs""", more=_OUTPUTS)


@query("running_bytes", RUNNING_BYTES)
def running_bytes(spark, sf_dir):
    return cluster.running_bytes(outputs(spark, sf_dir), "relay", "ts", ["event_id"]).select(
        "relay", "ts", "bytes", "total_bytes")


@query("traffic_savings", check("""SELECT head, CAST(SUM(raw) AS BIGINT) AS raw_bytes,
    CAST(SUM(cut) AS BIGINT) AS reduced_bytes,
    ROUND((SUM(raw) - SUM(cut)) * 100.0::DOUBLE / SUM(raw)::DOUBLE, 6) AS saved_percent FROM (
        SELECT head, octet_length(encode(CAST(node AS VARCHAR))) + octet_length(encode(concat_ws(',', event_id,
            CAST(lat AS BIGINT), CAST(lon AS BIGINT), CAST(ROUND(mph * 100) AS BIGINT), color,
            CAST(temperature AS BIGINT)))) AS raw, 0 AS cut FROM headed
        UNION ALL
        SELECT head, 0, 13 + octet_length(encode(concat_ws(',', CAST(SUM(units) AS BIGINT), COUNT(*))))
        FROM headed GROUP BY head, date_trunc('day', ts)) GROUP BY head""", "headed"))
def traffic_savings(spark, sf_dir):
    whole_row = f"""concat_ws(',', event_id, CAST(lat AS BIGINT), CAST(lon AS BIGINT), {MPH_UNITS}, color,
        CAST(temperature AS BIGINT))"""
    rows = _headed(spark, sf_dir).withColumn("sent", octets(F.col("node").cast("string"), F.expr(whole_row)))
    mapped = stock("speed_and_count").mapped(rows, keep=["head", "ts", "sent"])
    pair = F.expr("concat_ws(',', CAST(rint(total * 10000) AS BIGINT), n)")
    return cluster.traffic_savings(
        mapped, "average", F.col("sent"), pair, [F.date_trunc("day", "ts").alias("day")], digits=4)
