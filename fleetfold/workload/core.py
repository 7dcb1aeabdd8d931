"""Maps, filters, messages and reductions by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions import scalars as S
from fleetfold.operators import messages as M
from fleetfold.operators import opaque, reduce
from fleetfold.operators.status import assemble_status, status_from_map
from fleetfold.plans.spec import MapReduceQuery
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query, stock
from fleetfold.workload.tables import AVERAGE, TOTAL, check


@query("global_speed_avg", check(f"SELECT 'speedAndCount' AS key, {AVERAGE} FROM status"))
def global_speed_avg(spark, sf_dir):
    return stock("speed_and_count").run(t.status(spark, sf_dir))


@query("filter_map", check("SELECT event_id, color AS key, mph AS value FROM status WHERE mph > 50"))
def filter_map(spark, sf_dir):
    fast = MapReduceQuery("fast", "color", "mph", where="mph > 50D")
    return fast.mapped(t.status(spark, sf_dir), keep=["event_id"])


@query("opaque_filter_map", check("SELECT event_id, mph * 2 AS doubled FROM status WHERE color = 'red'"))
def opaque_filter_map(spark, sf_dir):
    rows = t.status(spark, sf_dir).select("event_id", "color", "mph")
    red = opaque.filter_batches(rows, lambda b: b["color"] == "red")
    return opaque.map_batches(red, lambda b: b[["event_id"]].assign(doubled=b["mph"] * 2),
                              "event_id bigint, doubled double")


@query("map_math", check("""SELECT event_id, mph * mph AS square, CAST(ROUND(mph) AS BIGINT) AS whole,
    LEAST(mph, temperature) AS low, GREATEST(mph, temperature) AS high,
    CASE WHEN temperature > 0 THEN mph / temperature ELSE 0.0 END AS quotient,
    ABS(mph - temperature) * 100.0 / NULLIF(temperature, 0) AS error_percent,
    CAST(sim_ts * 1000 AS BIGINT) AS sim_ms FROM status"""))
def map_math(spark, sf_dir):
    return t.status(spark, sf_dir).select(
        "event_id", (F.col("mph") * F.col("mph")).alias("square"),
        S.rounded_count("mph").alias("whole"),
        F.least("mph", "temperature").alias("low"), F.greatest("mph", "temperature").alias("high"),
        S.safe_quotient("mph", "temperature").alias("quotient"),
        S.percent_error("mph", "temperature").alias("error_percent"),
        S.seconds_to_ms(F.expr(t.SIM_TS)).alias("sim_ms"))


@query("status_from_map", check("""SELECT event_id, node AS id, lat, lon, mph, color, temperature, humidity,
    tireDistance, groundDistance, ax, ay, az FROM status WHERE mph <= 200 AND temperature <> 0"""))
def status_rows(spark, sf_dir):
    good, _ = status_from_map(t.status_map(spark, sf_dir))
    return good.select("*", *[F.col(f"acceleration.{a}").alias(f"a{a}") for a in "xyz"]).drop("acceleration")


@query("status_map_rejects", check("""SELECT event_id, CASE WHEN temperature = 0 THEN 'temperature'
    ELSE 'acceleration' END AS bad_field FROM status WHERE mph > 200 OR temperature = 0"""))
def status_map_rejects(spark, sf_dir):
    _, rejects = status_from_map(t.status_map(spark, sf_dir))
    return rejects.select("event_id", "bad_field")


ASSEMBLED = ("lat", "lon", "mph", "temperature")


@query("assemble_status", check("SELECT node, ts, lat, lon, mph, temperature FROM status WHERE mph <= 200"))
def assembled(spark, sf_dir):
    return assemble_status(t.readings_long(spark, sf_dir), ASSEMBLED)[0]


@query("assemble_status_rejects", check("SELECT node, ts FROM status WHERE mph > 200"))
def assembled_rejects(spark, sf_dir):
    return assemble_status(t.readings_long(spark, sf_dir), ASSEMBLED)[1].select("node", "ts")


@query("pos_and_accel", check("SELECT event_id, 'posAndAccel' AS key, mph, ax, ay, az FROM status"))
def pos_and_accel(spark, sf_dir):
    mapped = stock("pos_and_accel").mapped(t.status(spark, sf_dir), keep=["event_id"])
    return mapped.select("event_id", "key", "value.mph", *[
        F.col(f"value.acceleration.{a}").alias(f"a{a}") for a in "xyz"])


_MESSAGES = """messages AS (SELECT event_id, node AS key, mph AS value,
    CASE event_id % 3 WHEN 0 THEN 'q0' WHEN 1 THEN 'q1' END AS key_uid,
    CASE WHEN mph > 200 THEN 'q0' WHEN event_id % 3 = 0 THEN 'q0' WHEN event_id % 3 = 1 THEN 'q1' END AS value_uid,
    epoch_us(ts) // 1000 AS created_ms, temperature = 0 AS is_canary FROM status)"""


@query("drop_canaries", check("SELECT event_id, key, value FROM messages WHERE NOT is_canary", more=_MESSAGES))
def drop_canaries(spark, sf_dir):
    return M.drop_canaries(t.messages(spark, sf_dir)).select("event_id", "key", "value")


@query("query_tag_filter", check("""SELECT event_id, key, value FROM messages
    WHERE key_uid = 'q1' AND value_uid = 'q1'""", more=_MESSAGES))
def query_tag_filter(spark, sf_dir):
    return M.for_query(t.messages(spark, sf_dir), "q1").select("event_id", "key", "value")


@query("envelope_roundtrip", check("""SELECT key, value, key_uid, key_uid AS value_uid, created_ms, is_canary
    FROM messages""", more=_MESSAGES))
def envelope_roundtrip(spark, sf_dir):
    wrapped = M.wrap(t.messages(spark, sf_dir), F.col("key"), F.col("value"),
                     F.col("key_uid"), F.col("created_ms"), F.col("is_canary"))
    return M.unwrap(wrapped, "bigint", "double")


@query("multi_source_union", check("""SELECT 'speed' AS source, event_id, color AS key, mph AS value FROM status
    UNION ALL SELECT 'temperature', event_id, CAST(node AS VARCHAR), temperature FROM status"""))
def multi_source_union(spark, sf_dir):
    rows = t.status(spark, sf_dir)
    return M.concat_sources({
        "speed": rows.select("event_id", F.col("color").alias("key"), F.col("mph").alias("value")),
        "temperature": rows.select("event_id", F.col("node").cast("string").alias("key"),
                                   F.col("temperature").alias("value")),
    })


_TAGGED = """CASE color WHEN 'red' THEN 'avg' WHEN 'green' THEN 'sum' WHEN 'blue' THEN 'avg'
    WHEN 'white' THEN 'bad' ELSE 'sum' END AS op,
    CASE color WHEN 'red' THEN 'speed' WHEN 'green' THEN 'ids' WHEN 'blue' THEN 'ids'
    WHEN 'white' THEN 'bad' ELSE 'items' END AS item"""
_KNOWN = "((op = 'avg' AND item IN ('ids', 'speed')) OR (op = 'sum' AND item = 'ids'))"


def _tagged(spark, sf_dir):
    registry = spark.createDataFrame([("avg", "ids"), ("sum", "ids"), ("avg", "speed")], "op string, item string")
    return t.status(spark, sf_dir).selectExpr("event_id", *_TAGGED_PARTS), registry


_TAGGED_PARTS = [part + end for part, end in zip(_TAGGED.split(" AS op,"), (" AS op", ""))]


@query("route_by_query", check(f"SELECT * FROM (SELECT event_id, {_TAGGED} FROM status) WHERE {_KNOWN}"))
def route_by_query(spark, sf_dir):
    return M.route_by_query(*_tagged(spark, sf_dir))


@query("unrouted_messages", check(f"SELECT * FROM (SELECT event_id, {_TAGGED} FROM status) WHERE NOT {_KNOWN}"))
def unrouted_messages(spark, sf_dir):
    return M.unrouted(*_tagged(spark, sf_dir))


@query("message_status", check("""SELECT lead AS uuid, CASE WHEN color = 'black' THEN NULL
    WHEN mph <= 150 THEN 'GOOD' ELSE 'BAD' END AS status FROM ids""", "ids"))
def message_status(spark, sf_dir):
    sent = t.status(spark, sf_dir).selectExpr(f"{t.LEAD} AS uuid", "mph", "color")
    statuses = sent.where("color <> 'black'").selectExpr("uuid", """inline(array(
        named_struct('seq', 2, 'status', 'GOOD'),
        named_struct('seq', 1, 'status', CASE WHEN mph <= 150 THEN 'GOOD' ELSE 'BAD' END)))""")
    return M.first_status(sent.select("uuid"), statuses)


@query("speed_sum", check(f"SELECT 'allNodes' AS key, {TOTAL} AS value FROM status"))
def speed_sum(spark, sf_dir):
    return stock("speed_sum").run(t.status(spark, sf_dir))


@query("dual_speed", check(f"SELECT concat('getSpeed-', node) AS key, {TOTAL} AS value FROM status GROUP BY node"))
def dual_speed(spark, sf_dir):
    return stock("dual_speed").run(t.status(spark, sf_dir))


@query("dual_colors", check("""SELECT concat('getColor-', node) AS key,
    string_agg(DISTINCT color, ',' ORDER BY color) AS colors FROM status GROUP BY node"""))
def dual_colors(spark, sf_dir):
    sets = stock("dual_colors").run(t.status(spark, sf_dir))
    return sets.select("key", F.array_join("value", ",").alias("colors"))


@query("speed_min_max", check("""SELECT color AS key, MIN(mph) AS slowest, MAX(mph) AS fastest
    FROM status GROUP BY color"""))
def speed_min_max(spark, sf_dir):
    mapped = MapReduceQuery("by_color", "color", "mph").mapped(t.status(spark, sf_dir))
    return mapped.groupBy("key").agg(*[
        reduce.aggregates(op)[0].alias(name) for op, name in (("min", "slowest"), ("max", "fastest"))])


@query("speed_by_color", check(f"SELECT color AS key, {TOTAL} AS value FROM status GROUP BY color"))
def speed_by_color(spark, sf_dir):
    return stock("speed_by_color").run(t.status(spark, sf_dir))


@query("full_reduce", check(f"SELECT {AVERAGE} FROM status"))
def full_reduce(spark, sf_dir):
    return stock("speed_and_count").run_all(t.status(spark, sf_dir))


@query("send_all_first", check("""SELECT node AS key, arg_min(event_id, (ts, event_id)) AS event_id,
    MIN(ts) AS ts, arg_min(mph, (ts, event_id)) AS mph, arg_min(color, (ts, event_id)) AS color
    FROM status GROUP BY node"""))
def send_all_first(spark, sf_dir):
    rows = t.status(spark, sf_dir).select("event_id", "ts", "node", "mph", "color")
    return stock("send_all").run(rows).select(
        "key", "value.event_id", "value.ts", "value.mph", "value.color")


@query("latest_status", check("SELECT event_id, ts, node, mph, color FROM status ORDER BY ts DESC, event_id DESC LIMIT 1"))
def latest_status(spark, sf_dir):
    rows = t.status(spark, sf_dir).select("event_id", "ts", "node", "mph", "color")
    return reduce.latest_row(rows, ["ts", "event_id"])


@query("custom_reduce", check("SELECT node AS key, bit_xor(event_id) AS value FROM status GROUP BY node"))
def custom_reduce(spark, sf_dir):
    mapped = MapReduceQuery("ids", "node", "event_id").mapped(t.status(spark, sf_dir))
    return reduce.custom_reduce(mapped, "key", "value", lambda a, b: a ^ b)


@query("query_set_changes", check("""SELECT COALESCE(b.node, a.node) AS node, COALESCE(b.color, a.color) AS color,
    COALESCE(b.hour, a.hour) AS hour, CASE WHEN b.node IS NULL THEN 'started' ELSE 'stopped' END AS change
    FROM (SELECT DISTINCT node, color, hour FROM hours WHERE ts < TIMESTAMP '2024-01-16') b
    FULL JOIN (SELECT DISTINCT node, color, hour FROM hours WHERE ts >= TIMESTAMP '2024-01-16') a
    ON a.node = b.node AND a.color = b.color AND a.hour = b.hour WHERE a.node IS NULL OR b.node IS NULL""",
    more="hours AS (SELECT *, hour(ts) AS hour FROM status)"))
def query_set_changes(spark, sf_dir):
    rows = t.status(spark, sf_dir).withColumn("hour", F.hour("ts").cast("bigint"))
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    return reduce.set_changes(
        rows.where(F.col("ts") < split), rows.where(F.col("ts") >= split), ["node", "color", "hour"])


@query("event_sets", check("""SELECT color AS key, COUNT(DISTINCT event_id) AS members, CAST(SUM(event_id) AS BIGINT) AS total,
    true AS bounded FROM status GROUP BY color"""))
def event_sets(spark, sf_dir):
    """All event ids by colour, in rows of up to 500; the check adds them up again."""
    parts = reduce.set_chunks(t.status(spark, sf_dir), ["color"], "event_id", chunk=500)
    return parts.groupBy(F.col("color").alias("key")).agg(
        F.sum(F.size("event_id")).alias("members"),
        F.sum(F.aggregate("event_id", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("total"),
        (F.max(F.size("event_id")) <= 500).alias("bounded"))
