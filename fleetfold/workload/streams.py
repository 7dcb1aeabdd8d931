"""Structured Streaming runs over the events file; each gives back what its sink holds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetfold.operators import cluster
from fleetfold.operators import messages as M
from fleetfold.operators.messages import concat_sources
from fleetfold.plans.spec import MapReduceQuery, run_mixed
from fleetfold.session import cut_lineage, scratch_path
from fleetfold.sources.readers import csv_rows, file_stream
from fleetfold.streaming import queries as running
from fleetfold.streaming import sinks
from fleetfold.streaming.in_order import release_in_order, set_changes_in_order
from fleetfold.workload import clusters
from fleetfold.workload import tables as t
from fleetfold.workload.epochs import LANE_WINDOWS, LANES, MIXED, MIXED_CHECK, TAGGED, TAGGED_CHECK
from fleetfold.workload.registry import query, stock
from fleetfold.workload.tables import AVERAGE, check

EVENT_TYPE = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
DELAY = "1 hour"
LAST = datetime(2100, 1, 1)


def _status_stream(spark, sf_dir):
    schema = StructType.fromDDL(EVENT_TYPE)
    # As a pattern the path names the table whether it is one file or a folder of files.
    return t.as_status(file_stream(spark, f"{sf_dir}/events.parque[t]", schema))


def _places(spark, label):
    base = scratch_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"


_HOURLY = f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
    time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, color AS key, {AVERAGE}
    FROM status GROUP BY 1, 2, 3"""


def _by_color():
    return TAGGED[0]


@query("stream_windowed_speed_avg", check(_HOURLY))
def stream_windowed_speed_avg(spark, sf_dir):
    out, checkpoint = _places(spark, "windows")
    result = running.windowed(_by_color(), _status_stream(spark, sf_dir), "1 hour", delay=DELAY)
    sinks.upsert_results(result, out, checkpoint).awaitTermination()
    return sinks.latest_results(spark, out, ["window_start", "window_end", "key"])


@query("stream_closed_windows", check(f"""SELECT * FROM ({_HOURLY})
    WHERE window_end <= (SELECT MAX(ts) - INTERVAL '1 hour' FROM status)"""))
def stream_closed_windows(spark, sf_dir):
    out, checkpoint = _places(spark, "closed")
    result = running.windowed(_by_color(), _status_stream(spark, sf_dir), "1 hour", delay=DELAY)
    sinks.append_rows(result, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_multi_query_reduce", check(TAGGED_CHECK))
def stream_multi_query_reduce(spark, sf_dir):
    out, checkpoint = _places(spark, "tagged")
    result = running.multi_windowed(TAGGED, _status_stream(spark, sf_dir), "1 hour", delay=DELAY)
    sinks.upsert_results(result, out, checkpoint).awaitTermination()
    return sinks.latest_results(spark, out, ["query_uid", "window_start", "window_end", "key"])


@query("relay_copy", check("SELECT event_id, 'speedAndCount' AS key, mph AS value FROM status"))
def relay_copy(spark, sf_dir):
    out, checkpoint = _places(spark, "relay")
    mapped = stock("speed_and_count").mapped(_status_stream(spark, sf_dir), keep=["event_id"])
    sinks.relay(mapped, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("fan_out_copy", check("""SELECT sink, event_id, mph FROM status, (VALUES ('a'), ('b')) v(sink)"""))
def fan_out_copy(spark, sf_dir):
    out, checkpoint = _places(spark, "fan")
    stream = _status_stream(spark, sf_dir).select("event_id", "mph")
    sinks.fan_out(stream, [f"{out}/a", f"{out}/b"], checkpoint).awaitTermination()
    copies = {name: spark.read.parquet(f"{out}/{name}").drop("batch") for name in ("a", "b")}
    return concat_sources(copies, label="sink")


def _arriving(spark, df, time, label, closing):
    """A frame as a stream of several batches: written in slices of time, each a file or more, read one slice a trigger.

    Rows arrive up to half of ``DELAY`` late. ``closing`` is a last row far ahead, which lets the watermark pass all others.
    """
    late = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(30 * 60))
    rows = df.withColumn("_at", F.unix_seconds(F.col(time).cast("timestamp")) + late)
    span = rows.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    folder, slices = scratch_path(spark, label), 3
    if span.lo is not None:
        size = F.lit(max(1, -(-(span.hi + 1 - span.lo) // slices)))
        part = F.floor((F.col("_at") - F.lit(span.lo)) / size)
        # Made once, then copied slice by slice, since files arrive in the order of their writing.
        dealt = cut_lineage(rows.withColumn("_slice", part), f"{label}-dealt")
        for k in range(slices):
            dealt.where(F.col("_slice") == k).drop("_at", "_slice").write.mode("append").parquet(folder)
    open_type = StructType([StructField(f.name, f.dataType) for f in df.schema])
    last = spark.createDataFrame([tuple(closing.get(c) for c in df.columns)], open_type)
    last.coalesce(1).write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return file_stream(spark, folder, open_type, files_per_trigger=max(1, files // (slices + 1)))


# Each node holds from 23:00 and starts the epoch of the new day at 01:00. Fast
# vehicles' messages are for the next day, slow ones' for the day before.
@query("stream_epoch_release", check("""SELECT node, event_id, epoch, GREATEST(ts, epoch + INTERVAL '1 hour') AS released
    FROM (SELECT node, event_id, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE WHEN mph > 100 THEN INTERVAL '1 day'
        WHEN mph < 5 THEN INTERVAL '-1 day' ELSE INTERVAL '0 day' END AS epoch FROM status)
    WHERE ts < epoch + INTERVAL '23 hours'"""))
def stream_epoch_release(spark, sf_dir):
    span = t.status(spark, sf_dir).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    every = F.sequence(F.to_date(F.lit(span.lo)), F.date_add(F.to_date(F.lit(span.hi)), 1))
    days = t.nodes(spark, sf_dir).withColumn("d", F.explode(every)).selectExpr("node", "CAST(d AS TIMESTAMP) AS day")
    control = days.selectExpr("node", """inline(array(
            named_struct('at', day + INTERVAL '1' HOUR, 'kind', 'set', 'epoch', unix_micros(day)),
            named_struct('at', day + INTERVAL '23' HOUR, 'kind', 'hold', 'epoch', unix_micros(day))))""")
    messages = t.status(spark, sf_dir).selectExpr(
        "node", "CAST(ts AS TIMESTAMP) AS at",
        """unix_micros(date_trunc('day', ts)) + CASE WHEN mph > 100 THEN 86400000000L
            WHEN mph < 5 THEN -86400000000L ELSE 0L END AS epoch""", "event_id AS item")
    out, checkpoint = _places(spark, "release")
    released = release_in_order(
        _arriving(spark, messages, "at", "messages", {"at": LAST, "epoch": 0, "item": 0}),
        _arriving(spark, control, "at", "control", {"at": LAST, "kind": "hold", "epoch": 0}), DELAY, slots=2)
    sinks.append_rows(released, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).selectExpr(
        "node", "item AS event_id", "timestamp_micros(epoch) AS epoch", "released")


def _vehicles(spark, sf_dir, *columns, closing=None):
    rows = t.status(spark, sf_dir).select("event_id", "ts", "node", *columns)
    return _arriving(spark, rows, "ts", "vehicles", {"ts": LAST, **(closing or {})})


def _heads(spark, sf_dir):
    return _arriving(spark, t.membership(spark, sf_dir), "ts", "heads", {"ts": LAST, "node": -1})


@query("stream_cluster_head_asof", check("SELECT event_id, node, head FROM headed", "headed"))
def stream_cluster_head_asof(spark, sf_dir):
    out, checkpoint = _places(spark, "asof")
    routed = cluster.stream_heads(_vehicles(spark, sf_dir), _heads(spark, sf_dir), delay=DELAY, slots=2)
    sinks.append_rows(routed, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).where("event_id IS NOT NULL").select("event_id", "node", "head")


@query("stream_two_level_speed_avg", check(f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
    time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, color AS key, {AVERAGE},
    COUNT(DISTINCT head) AS heads FROM headed GROUP BY 1, 2, 3""", "headed"))
def stream_two_level_speed_avg(spark, sf_dir):
    out, checkpoint = _places(spark, "levels")
    routed = cluster.stream_heads(_vehicles(spark, sf_dir, "color", "mph"), _heads(spark, sf_dir), delay=DELAY, slots=2)
    sinks.append_rows(running.two_level(_by_color(), routed, "1 hour"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


_WRAPPED = """SELECT event_id, ts, node AS key, CASE WHEN event_id % 10 = 0 THEN NULL ELSE mph END AS value,
    CASE event_id % 3 WHEN 0 THEN 'q0' WHEN 1 THEN 'q1' END AS key_uid,
    CASE WHEN mph > 200 THEN 'q0' WHEN event_id % 3 = 0 THEN 'q0' WHEN event_id % 3 = 1 THEN 'q1' END AS value_uid,
    temperature = 0 AS is_canary FROM status"""


def _topics(spark, sf_dir):
    """Enveloped messages of two brokers, odd and even events, as two streams."""
    rows = spark.sql(_WRAPPED.replace("FROM status", "FROM {status}"), status=t.status(spark, sf_dir))
    topics = {}
    for name, rest in (("even", 0), ("odd", 1)):
        part = rows.where(F.col("event_id") % 2 == rest)
        created = F.unix_millis(F.col("ts").cast("timestamp"))
        last = M.wrap(spark.range(1), F.lit(-1).cast("bigint"), F.lit(0.0), F.lit("q1"), F.unix_millis(F.lit(LAST))).first()
        sent = part.withColumns({"k": F.col("key"), "v": F.col("value")})
        sent = M.wrap_columns(sent, F.col("k"), F.col("v"), F.col("key_uid"), created, F.col("is_canary"), F.col("value_uid"))
        topics[name] = _arriving(spark, sent.select("key", "value", "ts"), "ts", name, last.asDict()).drop("ts")
    return topics


@query("stream_envelope_reduce", check(f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
    time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, key,
    CAST(SUM(CAST(ROUND(value * 10000) AS BIGINT)) AS DOUBLE) / 10000.0 AS value FROM wrapped
    WHERE key_uid = 'q1' AND value_uid = 'q1' AND value IS NOT NULL AND NOT is_canary GROUP BY 1, 2, 3""",
    more=f"wrapped AS ({_WRAPPED})"))
def stream_envelope_reduce(spark, sf_dir):
    out, checkpoint = _places(spark, "envelopes")
    records = running.enveloped("q1", _topics(spark, sf_dir), "bigint", "double", observation="tags")
    summed = MapReduceQuery("sums", "key", "value", "sum", digits=4)
    sinks.append_rows(running.windowed(summed, records, "1 hour", delay=DELAY), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("fan_in_relay", check("SELECT key, value, key_uid, value_uid, epoch_us(ts) // 1000 AS created_ms, is_canary FROM wrapped",
                             more=f"wrapped AS ({_WRAPPED})"))
def fan_in_relay(spark, sf_dir):
    out, checkpoint = _places(spark, "fan-in")
    sinks.relay(concat_sources(_topics(spark, sf_dir), label="broker"), out, checkpoint).awaitTermination()
    return M.unwrap(spark.read.parquet(out), "bigint", "double").where("key IS NULL OR key >= 0")


@query("stream_multi_query_mixed_reduce", check(MIXED_CHECK))
def stream_multi_query_mixed_reduce(spark, sf_dir):
    out, checkpoint = _places(spark, "mixed")
    rows = running.event_time(_vehicles(spark, sf_dir, "color", "mph", "temperature"), delay=DELAY)
    sinks.append_rows(run_mixed(MIXED, rows, "6 hours"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).withColumn("members", F.array_join("members", ","))


@query("stream_custom_reduce", check(LANE_WINDOWS))
def stream_custom_reduce(spark, sf_dir):
    out, checkpoint = _places(spark, "folds")
    # Filters go below the watermark, so the closing row has to pass them.
    vehicles = _vehicles(spark, sf_dir, "color", "mph", closing={"node": 0, "color": "none", "mph": 100.0})
    rows = running.event_time(vehicles, delay=DELAY)
    sinks.append_rows(LANES.run_windowed(rows, "1 day", slots=2), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("window_start", "window_end", "key", "value.*")


# White vehicles' statuses come two hours late, black ones' never, and red ones' messages get a second status and one for an unknown message.
_REPORTS = """reports AS (SELECT lead AS uuid, ts + INTERVAL '10 seconds' AS ts, 2 AS seq, 'GOOD' AS status FROM ids WHERE color = 'red'
    UNION ALL SELECT lead, ts + CASE WHEN color = 'white' THEN INTERVAL '2 hours' ELSE INTERVAL '10 seconds' END, 1,
        CASE WHEN mph <= 150 THEN 'GOOD' ELSE 'BAD' END FROM ids WHERE color <> 'black'
    UNION ALL SELECT follow, ts, 1, 'GOOD' FROM ids WHERE color = 'red')"""


def _sent_and_told(spark, sf_dir):
    rows = t.status(spark, sf_dir).selectExpr(f"{t.LEAD} AS uuid", f"{t.FOLLOW} AS other", "ts", "mph", "color")
    told = rows.selectExpr("""inline(array_compact(array(
        CASE WHEN color = 'red' THEN named_struct('uuid', uuid, 'ts', ts + INTERVAL '10' SECOND, 'seq', 2, 'status', 'GOOD') END,
        CASE WHEN color <> 'black' THEN named_struct('uuid', uuid, 'ts', ts + CASE WHEN color = 'white' THEN INTERVAL '7200' SECOND
            ELSE INTERVAL '10' SECOND END, 'seq', 1, 'status', CASE WHEN mph <= 150 THEN 'GOOD' ELSE 'BAD' END) END,
        CASE WHEN color = 'red' THEN named_struct('uuid', other, 'ts', ts, 'seq', 1, 'status', 'GOOD') END)))""")
    return (_arriving(spark, rows.select("uuid", "ts"), "ts", "sent", {"ts": LAST, "uuid": "closing"}),
            _arriving(spark, told, "ts", "told", {"ts": LAST, "uuid": "none", "seq": 0}))


@query("stream_message_status", check("""SELECT lead AS uuid, CASE WHEN color IN ('black', 'white') THEN NULL
    WHEN mph <= 150 THEN 'GOOD' ELSE 'BAD' END AS status FROM ids""", "ids"))
def stream_message_status(spark, sf_dir):
    out, checkpoint = _places(spark, "statuses")
    sinks.append_rows(running.first_status(*_sent_and_told(spark, sf_dir), delay=DELAY), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_stray_statuses", check("""SELECT uuid, ts, seq, status FROM reports r
    WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.lead = r.uuid AND r.ts BETWEEN i.ts AND i.ts + INTERVAL '1 hour')""", "ids", more=_REPORTS))
def stream_stray_statuses(spark, sf_dir):
    out, checkpoint = _places(spark, "strays")
    sinks.append_rows(running.stray_statuses(*_sent_and_told(spark, sf_dir), delay=DELAY), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).where("uuid <> 'none'")


# A node's epoch is the day from 01:00 on. Fast vehicles' messages are for the next day, slow ones' for the day before.
@query("stream_epoch_route", check("""SELECT event_id, CASE WHEN current IS NULL OR epoch > current THEN 'buffer'
    WHEN epoch = current THEN 'deliver' ELSE 'drop' END AS route FROM (SELECT event_id,
        date_trunc('day', ts) + CASE WHEN mph > 100 THEN INTERVAL '1 day' WHEN mph < 5 THEN INTERVAL '-1 day' ELSE INTERVAL '0 day' END AS epoch,
        CASE WHEN date_trunc('day', ts - INTERVAL '1 hour') >= (SELECT date_trunc('day', MIN(ts)) FROM status)
            THEN date_trunc('day', ts - INTERVAL '1 hour') END AS current FROM status)"""))
def stream_epoch_route(spark, sf_dir):
    span = t.status(spark, sf_dir).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    every = F.sequence(F.to_date(F.lit(span.lo)), F.to_date(F.lit(span.hi)))
    days = t.nodes(spark, sf_dir).withColumn("d", F.explode(every))
    epochs = days.selectExpr("node", "CAST(d AS TIMESTAMP) + INTERVAL '1' HOUR AS at", "unix_micros(CAST(d AS TIMESTAMP)) AS epoch")
    messages = t.status(spark, sf_dir).selectExpr(
        "node", "CAST(ts AS TIMESTAMP) AS at", """unix_micros(date_trunc('day', ts)) + CASE WHEN mph > 100 THEN 86400000000L
            WHEN mph < 5 THEN -86400000000L ELSE 0L END AS epoch""", "event_id")
    out, checkpoint = _places(spark, "routes")
    routed = running.route_epochs(_arriving(spark, messages, "at", "messages", {"at": LAST}),
                                  _arriving(spark, epochs, "at", "epochs", {"node": -1, "at": LAST, "epoch": 0}), DELAY, slots=2)
    sinks.append_rows(routed, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).where("event_id IS NOT NULL").select("event_id", "route")


# The set of a day is the colours that a node was seen in on it; the last day's sets stop when the stream closes.
@query("stream_query_set_changes", check("""SELECT node, color, day AS at, 'started' AS change FROM sets a
    WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.node = a.node AND b.color = a.color AND b.day = a.day - INTERVAL '1 day')
    UNION ALL SELECT node, color, day + INTERVAL '1 day', 'stopped' FROM sets a
    WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.node = a.node AND b.color = a.color AND b.day = a.day + INTERVAL '1 day')""",
    more="sets AS (SELECT DISTINCT node, color, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM status)"))
def stream_query_set_changes(spark, sf_dir):
    sets = t.status(spark, sf_dir).select("node", "color", F.date_trunc("day", "ts").alias("day")).distinct()
    out, checkpoint = _places(spark, "sets")
    arriving = _arriving(spark, sets, "day", "snapshots", {"node": -1, "day": LAST})
    sinks.append_rows(set_changes_in_order(arriving, ["node", "color"], "day", "1 day", DELAY), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_running_bytes", clusters.RUNNING_BYTES)
def stream_running_bytes(spark, sf_dir):
    out, checkpoint = _places(spark, "bytes")
    sent = _arriving(spark, clusters.outputs(spark, sf_dir), "ts", "outputs", {"relay": -1, "ts": LAST})
    log = cluster.stream_running_bytes(sent, "relay", "ts", ["event_id"], bucket="6 hours", delay=DELAY)
    columns = ["relay", "ts", "bytes", "total_bytes"]
    sinks.append_csv(log.select(*columns), out, checkpoint).awaitTermination()
    return csv_rows(spark, out, log.select(*columns).schema)
