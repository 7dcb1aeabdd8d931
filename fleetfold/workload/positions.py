"""Reading tables, time lookups and order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.operators import scans
from fleetfold.operators import timeseries as ts
from fleetfold.operators.geo import DENSE_VIEW, SPARSE_VIEW, inside
from fleetfold.operators.status import positions_as_status
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query
from fleetfold.workload.tables import check


def _positions(spark, sf_dir):
    return ts.node_positions(*t.readings(spark, sf_dir))


@query("node_positions", check("SELECT * FROM positions", "positions"))
def node_positions(spark, sf_dir):
    return _positions(spark, sf_dir)


@query("dense_positions", check("""SELECT * FROM positions
    WHERE x > 50000 AND x < 51000 AND y > 100000 AND y < 102000""", "positions"))
def dense_positions(spark, sf_dir):
    return _positions(spark, sf_dir).where(inside(DENSE_VIEW, "x", "y", closed=False))


@query("sparse_positions", check("""SELECT * FROM positions
    WHERE x > 40000 AND x < 53000 AND y > 106800 AND y < 114000""", "positions"))
def sparse_positions(spark, sf_dir):
    return _positions(spark, sf_dir).where(inside(SPARSE_VIEW, "x", "y", closed=False))


@query("position_status", check("""SELECT node, timestamp, x AS lat, y AS lon, speed AS mph
    FROM positions""", "positions"))
def position_status(spark, sf_dir):
    return positions_as_status(_positions(spark, sf_dir))


@query("downsample", check("SELECT * FROM posx WHERE timestamp % 1 = 0", "posx"))
def downsample(spark, sf_dir):
    return ts.downsample(t.readings(spark, sf_dir)[0], 1.0)


@query("time_range", check("""SELECT MIN(timestamp) AS first_ts, MAX(timestamp) AS last_ts FROM posx
    WHERE timestamp % 1 = 0""", "posx"))
def time_range(spark, sf_dir):
    return ts.time_range(t.readings(spark, sf_dir)[0], 1.0)


@query("node_ids", check("SELECT DISTINCT node FROM posx", "posx"))
def node_ids(spark, sf_dir):
    return ts.node_ids(t.readings(spark, sf_dir)[0])


@query("first_nodes", check("SELECT DISTINCT node FROM posx ORDER BY node LIMIT 10", "posx"))
def first_nodes(spark, sf_dir):
    return ts.first_nodes(t.readings(spark, sf_dir)[0], 10)


@query("timing_queue", check("""SELECT timestamp, node // 1000 AS node_block,
    string_agg(DISTINCT CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS nodes
    FROM (SELECT node, floor(timestamp / 3600) * 3600 AS timestamp FROM posx) GROUP BY 1, 2""", "posx"))
def timing_queue(spark, sf_dir):
    hourly = t.readings(spark, sf_dir)[0].withColumn("timestamp", F.expr("CAST(floor(timestamp / 3600) * 3600 AS DOUBLE)"))
    queue = ts.timing_queue(hourly)
    return queue.withColumn("nodes", F.array_join(F.array_sort(F.col("nodes").cast("array<string>")), ","))


@query("concurrent_nodes", check("""SELECT DISTINCT node FROM positions WHERE node <> 3
    AND timestamp <= (SELECT MIN(timestamp) FROM positions WHERE node = 3)""", "positions"))
def concurrent_nodes(spark, sf_dir):
    return ts.concurrent_nodes(_positions(spark, sf_dir), 3)


def _lookup(spark, sf_dir):
    rows = t.status(spark, sf_dir).select("event_id", "node", F.expr(t.SIM_TS).alias("timestamp"))
    return scans.exact_lookup(rows, _positions(spark, sf_dir), ["node", "timestamp"])


@query("position_lookup", check("""SELECT s.event_id, s.node, p.timestamp, p.x, p.y, p.speed
    FROM status s JOIN positions p ON s.node = p.node AND s.sim_ts = p.timestamp""", "positions"))
def position_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir)[0]


@query("position_lookup_misses", check("""SELECT event_id, node, sim_ts AS timestamp FROM status s
    WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE s.node = p.node AND s.sim_ts = p.timestamp)""", "positions"))
def position_lookup_misses(spark, sf_dir):
    return _lookup(spark, sf_dir)[1]


@query("cluster_head_or_self", check("""SELECT s.event_id, s.node, COALESCE(m.head, s.node) AS head
    FROM status s LEFT JOIN membership m ON s.node = m.node AND s.ts = m.ts""", "membership"))
def cluster_head_or_self(spark, sf_dir):
    rows = t.status(spark, sf_dir).select("event_id", "node", "ts")
    return ts.head_or_self(rows, t.membership(spark, sf_dir), "ts").select("event_id", "node", "head")


_AS_OF = check("""SELECT s.event_id, s.node, m.head FROM status s
    ASOF LEFT JOIN membership m ON s.node = m.node AND s.ts >= m.ts""", "membership")


def _as_of(spark, sf_dir, strategy):
    rows = t.status(spark, sf_dir).select("event_id", "node", "ts")
    return scans.as_of(rows, t.membership(spark, sf_dir), "node", "ts", "ts", "head", strategy).drop("ts")


@query("cluster_head_asof", _AS_OF)
def cluster_head_asof(spark, sf_dir):
    return _as_of(spark, sf_dir, "auto")


@query("cluster_head_asof_scan", _AS_OF)
def cluster_head_asof_scan(spark, sf_dir):
    return _as_of(spark, sf_dir, "scan")


@query("first_n_per_node", check("""SELECT node, ts, mph FROM status
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts) <= 5"""))
def first_n_per_node(spark, sf_dir):
    return scans.first_n(t.status(spark, sf_dir).select("node", "ts", "mph"), ["node"], ["ts"], 5)


@query("ordered_concat", check("""SELECT node, day, piece, string_agg(substr(color, 1, 2), '' ORDER BY ts, event_id) AS text
    FROM (SELECT *, date_trunc('day', ts) AS day, CAST((row_number() OVER (
        PARTITION BY node, date_trunc('day', ts) ORDER BY ts, event_id) - 1) // 4 AS BIGINT) AS piece FROM status)
    GROUP BY node, day, piece""").replace("date_trunc('day', ts) AS day", "CAST(date_trunc('day', ts) AS TIMESTAMP) AS day"))
def ordered_concat(spark, sf_dir):
    rows = t.status(spark, sf_dir).select(
        "event_id", "node", "ts", F.date_trunc("day", "ts").alias("day"), F.substring("color", 1, 2).alias("two"))
    return scans.ordered_fold(rows, ["node", "day"], "ts", "two", ["event_id"], piece=4)
