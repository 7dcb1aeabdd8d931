"""Streams whose result must not depend on how rows fall into files and batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fleetfold import MapReduceQuery
from fleetfold.operators import cluster, messages, reduce, scans
from fleetfold.sources import readers
from fleetfold.streaming import queries as running
from fleetfold.streaming import sinks
from fleetfold.streaming.in_order import as_of_in_order, release_in_order, running_total_in_order, set_changes_in_order

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def staged(spark, path, rows, schema, files):
    """Rows written as one file after another."""
    step = -(-len(rows) // files)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k:k + step], schema).coalesce(1).write.mode("append").parquet(path)
    return readers.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


MESSAGES = "node long, at timestamp, epoch long, item long"
CONTROL = "node long, at timestamp, kind string, epoch long"
FAR = 100_000


def released(spark, folder, name, messages, control, files, **options):
    streams = [staged(spark, folder(f"{name}-m"), messages, MESSAGES, files[0]), staged(spark, folder(f"{name}-c"), control, CONTROL, files[1])]
    sinks.append_rows(release_in_order(*streams, slots=2, **options), folder(f"{name}-out"), folder(f"{name}-check")).awaitTermination()
    got = spark.read.parquet(folder(f"{name}-out")).where("node is not null").collect()
    return sorted((r.node, r.item, (r.released - START).total_seconds()) for r in got)


@pytest.mark.parametrize("files", [(1, 1), (2, 3), (5, 2), (8, 8)])
def test_release_does_not_depend_on_batches(spark, folder, files):
    control = [(1, at(10), "set", 100), (1, at(30), "set", 200), (1, at(50), "hold", None), (1, at(70), "set", 300),
               (2, at(40), "set", 200), (None, at(FAR), "hold", None), (None, at(FAR), "hold", None), (None, at(FAR), "hold", None)]
    messages = [(1, at(5), 100, 10), (1, at(6), 50, 11), (1, at(20), 100, 12), (1, at(21), 200, 13), (1, at(40), 200, 14),
                (1, at(41), 100, 15), (1, at(55), 300, 16), (1, at(56), 200, 17), (2, at(39), 200, 18), (2, at(40), 200, 19),
                (1, at(70), 300, 20), (1, None, 300, 21), (1, at(75), 300, 22), (None, at(FAR), 0, 0), (None, at(FAR), 0, 0), (None, at(FAR), 0, 0)]
    got = released(spark, folder, "r", messages, control, files, delay="1 hour")
    assert got == [(1, 10, 10), (1, 12, 20), (1, 13, 30), (1, 14, 40), (1, 16, 70), (1, 20, 70), (1, 22, 75), (2, 18, 40), (2, 19, 40)]


def test_release_keeps_what_the_watermark_has_not_passed(spark, folder):
    messages = [(1, at(20), 100, 1), (1, at(100), 100, 2)]
    got = released(spark, folder, "r", messages, [(1, at(10), "set", 100), (1, at(100), "set", 100)], (2, 2), delay="30 seconds")
    assert got == [(1, 1, 20)]


def test_kept_messages_expire(spark, folder):
    messages = [(1, at(5), 200, 1), (1, at(50), 200, 2), (None, at(FAR), 0, 0)]
    control = [(1, at(10), "set", 100), (1, at(80), "set", 200), (None, at(FAR), "hold", None)]
    assert released(spark, folder, "a", messages, control, (3, 3), delay="1 hour", expire="60 seconds") == [(1, 2, 80)]
    assert released(spark, folder, "b", messages, control, (3, 3), delay="1 hour") == [(1, 1, 80), (1, 2, 80)]


@pytest.mark.parametrize("files, turned", [((1, 1), False), ((6, 2), False), ((2, 6), True), ((7, 7), True)])
def test_streamed_as_of_equals_batch(spark, folder, files, turned):
    facts = [(i % 3 if i % 7 else None, at(i * 10), 2**53 + i, at(i), f"p{i}" if i % 5 else None) for i in range(60)]
    changes = [(i % 3, at(i * 25 + (i % 2) * 5), i * 1000) for i in range(20)] + [(1, at(250), 7), (1, at(250), None), (2, at(60), None)]
    changes += [(None, at(5), 5), (0, None, 6)]
    if turned:
        facts, changes = facts[::-1], changes[::-1]
    fact_type, change_type = "node long, ts timestamp_ntz, event long, made timestamp, note string", "node long, since timestamp_ntz, head long"
    closing = [(None, at(FAR), None, None, None)], [(-1, at(FAR), None)]
    left = staged(spark, folder("l"), facts + closing[0], fact_type, files[0])
    right = staged(spark, folder("r"), changes + closing[1], change_type, files[1])
    joined = as_of_in_order(left, right, "node", "ts", "since", "head", delay="1 hour", slots=3)
    sinks.append_rows(joined, folder("out"), folder("check")).awaitTermination()
    got = spark.read.parquet(folder("out"))
    want = scans.as_of(spark.createDataFrame(facts, fact_type).withColumn("ts", F.col("ts").cast("timestamp")),
                       spark.createDataFrame(changes, change_type).withColumn("since", F.col("since").cast("timestamp")),
                       "node", "ts", "since", "head", strategy="broadcast")
    got = got.where(F.col("ts") < F.lit(at(FAR)))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("files", [(1, 1), (4, 3)])
def test_two_levels_behind_streamed_heads_equal_batch(spark, folder, files):
    statuses = [(i % 4, at(i * 7), "red" if i % 3 else "blue", i / 4) for i in range(80)]
    members = [(i % 4, at(i * 40), 100 + i % 3) for i in range(12)]
    status_type, member_type = "node long, ts timestamp, color string, mph double", "node long, ts timestamp, head long"
    query = MapReduceQuery("by-color", "color", "mph", "average", digits=4)
    routed = cluster.stream_heads(
        staged(spark, folder("s"), statuses + [(None, at(FAR), None, None)], status_type, files[0]),
        staged(spark, folder("m"), members + [(-1, at(FAR), None)], member_type, files[1]), delay="1 hour", slots=2)
    sinks.append_rows(running.two_level(query, routed, "1 minute"), folder("out"), folder("check")).awaitTermination()
    heads = cluster.assign_heads(spark.createDataFrame(statuses, status_type), spark.createDataFrame(members, member_type), strategy="broadcast")
    want = query.run_windowed(heads, "1 minute")
    reported = heads.groupBy(F.window("ts", "1 minute").start.alias("window_start"), F.col("color").alias("key")).agg(
        F.countDistinct("head").alias("heads"))
    want = want.join(reported, ["window_start", "key"])
    got = spark.read.parquet(folder("out")).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_results_merge_like_their_rows(spark):
    rows = spark.createDataFrame([(k, h, float(v)) for v in range(40) for k, h in [(v % 2, v % 5)]], "key int, head int, value double")
    for op in ("sum", "min", "max", "average", "union"):
        once = rows.groupBy("key").agg(*reduce.aggregates(op, digits=4))
        twice = rows.groupBy("key", "head").agg(*reduce.aggregates(op, digits=4)).groupBy("key").agg(*reduce.merges(op, digits=4))
        assert sorted(once.collect()) == sorted(twice.select(*once.columns).collect())
    with pytest.raises(ValueError):
        reduce.merges("first")


SENT = "k long, v double, key_uid string, value_uid string, ms long, canary boolean"
RECORDS = [(1, 2.0, "q", "q", 1000, False), (1, 3.0, "q", "q", 2000, False), (1, 9.0, "q", "p", 1000, False), (2, None, "q", "q", 1000, False),
           (2, 5.0, "q", "q", 1000, True), (2, 6.0, None, "q", 3000, False), (2, 7.0, "p", "p", 3000, False), (3, 8.0, "q", "q", 3000, None)]


def enveloped(spark, rows):
    sent = spark.createDataFrame(rows, SENT)
    return messages.wrap(sent, F.col("k"), F.col("v"), F.col("key_uid"), F.col("ms"), F.col("canary"), F.col("value_uid"))


def test_clashing_tags_are_counted_on_the_pass_that_filters(spark):
    seen = Observation("tags")
    typed = messages.unwrap(enveloped(spark, RECORDS), "bigint", "double")
    kept = messages.for_query(typed, "q", observation=seen).collect()
    assert {(r.key, r.value) for r in kept} == {(1, 2.0), (1, 3.0), (2, None), (2, 5.0), (3, 8.0)}
    assert seen.get == {"records": 8, "clashing": 2}


def test_enveloped_streams_fan_in_and_report_clashes(spark, folder):
    for name, part in (("a", RECORDS[::2]), ("b", RECORDS[1::2])):
        for r in part:
            enveloped(spark, [r]).coalesce(1).write.mode("append").parquet(folder(name))
    schema = enveloped(spark, RECORDS).schema
    sources = {n: readers.file_stream(spark, folder(n), schema, files_per_trigger=2) for n in ("a", "b")}
    stream = running.enveloped("q", sources, "bigint", "double", observation="tags")
    query = sinks.relay(stream, folder("out"), folder("check"))
    query.awaitTermination()
    got = spark.read.parquet(folder("out")).collect()
    assert sorted((r.key, r.value, r.ts.second) for r in got) == [(1, 2.0, 1), (1, 3.0, 2), (3, 8.0, 3)]
    seen = [p.observedMetrics["tags"].asDict() for p in query.recentProgress if "tags" in p.observedMetrics]
    assert len(seen) > 1 and sum(s["clashing"] for s in seen) == 2


@pytest.mark.parametrize("files", [(1, 1), (5, 4)])
def test_first_statuses_and_strays_of_streams(spark, folder, files):
    sends = [(f"m{i}", at(i * 10)) for i in range(12)]
    told = [(f"m{i}", at(i * 10 + 30), 2, "BAD") for i in range(12) if i % 4] + [(f"m{i}", at(i * 10 + 30), 1, "GOOD") for i in range(0, 12, 3)]
    told += [("m1", at(20), 3, "FIRST"), ("m8", at(80 + 7200), 1, "LATE"), ("m9", at(80), 1, "EARLY"), ("x", at(50), 1, "UNKNOWN"), (None, at(5), 1, "NONE")]
    told.sort(key=lambda r: r[1])
    pair = (staged(spark, folder("s"), sends + [("closing", at(FAR))], "uuid string, ts timestamp", files[0]),
            staged(spark, folder("t"), told + [("none", at(FAR), 0, "")], "uuid string, ts timestamp, seq int, status string", files[1]))
    sinks.append_rows(running.first_status(*pair, delay="3 hours"), folder("out"), folder("c1")).awaitTermination()
    got = {r.uuid: r.status for r in spark.read.parquet(folder("out")).collect()}
    want = {f"m{i}": "GOOD" if i % 3 == 0 else "BAD" if i % 4 else None for i in range(12)} | {"m1": "FIRST"}
    assert got == want
    sinks.append_rows(running.stray_statuses(*pair, delay="3 hours"), folder("strays"), folder("c2")).awaitTermination()
    assert {r.status for r in spark.read.parquet(folder("strays")).where("uuid <> 'none'").collect()} == {"LATE", "EARLY", "UNKNOWN"}


def test_routes_follow_the_epochs_of_the_stream(spark, folder):
    messages = [(1, at(5), 100, 1), (1, at(20), 100, 2), (1, at(21), 200, 3), (1, at(40), 100, 4), (2, at(40), 200, 5), (1, at(30), 200, 6)]
    epochs = [(1, at(10), 100), (1, at(30), 200), (2, at(50), 200)]
    stream = running.route_epochs(
        staged(spark, folder("m"), messages + [(None, at(FAR), 0, None)], MESSAGES, 3),
        staged(spark, folder("e"), epochs + [(-1, at(FAR), 0)], "node long, at timestamp, epoch long", 2), delay="1 hour", slots=2)
    sinks.append_rows(stream, folder("out"), folder("check")).awaitTermination()
    got = {r.item: r.route for r in spark.read.parquet(folder("out")).where("item is not null").collect()}
    assert got == {1: "buffer", 2: "deliver", 3: "buffer", 4: "drop", 5: "buffer", 6: "deliver"}


@pytest.mark.parametrize("files", [1, 5])
def test_changes_of_a_streamed_set(spark, folder, files):
    held = {"a": [0, 1, 2, 5, 6], "b": [0], "c": [3, 4, 5, 6], None: [1]}
    rows = sorted([(k, at(3600 * n)) for k, times in held.items() for n in times] * 2, key=lambda r: r[1])
    stream = staged(spark, folder("in"), rows + [("late", None), ("end", at(3600 * 9))], "query string, seen timestamp", files)
    changes = set_changes_in_order(stream, ["query"], "seen", "1 hour", delay="2 hours")
    sinks.append_rows(changes, folder("out"), folder("check")).awaitTermination()
    got = {(r.query, (r.at - START).total_seconds() / 3600, r.change) for r in spark.read.parquet(folder("out")).collect()}
    assert got == {("a", 0, "started"), ("a", 3, "stopped"), ("a", 5, "started"), ("a", 7, "stopped"), ("b", 0, "started"), ("b", 1, "stopped"),
                   ("c", 3, "started"), ("c", 7, "stopped"), (None, 1, "started"), (None, 2, "stopped")}


@pytest.mark.parametrize("files", [1, 5])
def test_running_totals_carry_over_batches(spark, folder, files):
    rows = [(k, at(s), i, n) for i, (k, s, n) in enumerate([
        ("hot", 5, 1), ("hot", 3, 10), ("cold", 30, 7), ("hot", 700, 100), ("hot", 699, None), (None, 800, 3), ("hot", 600, 1000),
        ("hot", 4000, 5), ("cold", 4000, 1), ("hot", 4000, 6), (None, 9000, 4), ("hot", 8000, 2), ("cold", 9100, 9), ("hot", 599, 20)])]
    schema = "relay string, ts timestamp_ntz, id long, bytes long"
    stream = staged(spark, folder("in"), rows + [("hot", None, 99, 50), ("hot", at(FAR), 100, 1)], schema, files)
    totals = running_total_in_order(stream, ["relay"], "ts", "bytes", "total", ["id"], bucket="10 minutes", delay="3 hours")
    sinks.append_csv(totals, folder("out"), folder("check")).awaitTermination()
    got = readers.csv_rows(spark, folder("out"), schema + ", total long")
    batch = scans.running_total(spark.createDataFrame(rows, schema), ["relay"], "ts", F.coalesce("bytes", F.lit(0)), "total", ["id"])
    want = [tuple(r) for r in batch.orderBy("id").collect()]
    assert len(want) == 14 and [tuple(r) for r in got.orderBy("id").collect()] == want


def test_running_totals_leave_out_late_rows_alike(spark, folder):
    rows = [("a", at(10), 1, 1), ("a", at(20_000), 2, 2), ("a", at(30_000), 3, 4), ("a", at(15), 4, 8), ("a", at(30_001), 5, 16), ("a", at(FAR), 6, 0)]
    stream = staged(spark, folder("in"), rows, "relay string, ts timestamp, id long, bytes long", 6)
    totals = running_total_in_order(stream, ["relay"], "ts", "bytes", "total", ["id"], bucket="10 minutes", delay="1 minute")
    sinks.append_rows(totals, folder("out"), folder("check")).awaitTermination()
    got = {r.id: r.total for r in spark.read.parquet(folder("out")).collect()}
    assert got == {1: 1, 2: 3, 3: 7, 5: 23}
