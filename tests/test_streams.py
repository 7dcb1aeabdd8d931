"""Streams in several batches, restarts, and readers and writers."""

import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetfold import MapReduceQuery
from fleetfold.operators.reduce import _fold_tasks
from fleetfold.schema import READING, STATUS
from fleetfold.session import shared_dir, size_shuffles
from fleetfold.sources import readers
from fleetfold.streaming import queries as running
from fleetfold.streaming import sinks
from fleetfold.streaming.release import EpochGate, release_by_epoch

START = datetime(2024, 1, 1)
ROWS = "ts timestamp, color string, mph double"
BY_COLOR = MapReduceQuery("by-color", "color", "mph", "average", digits=4)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def write_batches(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_over_many_files(spark, folder):
    batches = [[(START + timedelta(seconds=60 * b + i), "red" if i % 2 else "blue", float(i)) for i in range(20)]
               for b in range(4)]
    write_batches(spark, folder("in"), batches)
    stream = readers.file_stream(spark, folder("in"), spark.read.parquet(folder("in")).schema, files_per_trigger=1)
    result = running.windowed(BY_COLOR, stream, "30 seconds", delay="1 hour")
    sinks.upsert_results(result, folder("out"), folder("check")).awaitTermination()
    got = sinks.latest_results(spark, folder("out"), ["window_start", "window_end", "key"])
    want = BY_COLOR.run_windowed(spark.read.parquet(folder("in")), "30 seconds")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_restarted_stream_goes_on_where_it_stopped(spark, folder):
    schema = spark.createDataFrame([], ROWS).schema
    for day in range(2):
        write_batches(spark, folder("in"), [[(START + timedelta(days=day), "red", 1.0)]])
        result = running.windowed(BY_COLOR, readers.file_stream(spark, folder("in"), schema), "7 days", delay="1 day")
        sinks.upsert_results(result, folder("out"), folder("check")).awaitTermination()
    got = sinks.latest_results(spark, folder("out"), ["window_start", "window_end", "key"]).collect()
    assert [(r["total"], r["n"]) for r in got] == [(2.0, 2)]


def test_merged_results_are_read_once(spark, folder):
    keys = ["window_start", "window_end", "key"]
    schema = spark.createDataFrame([], ROWS).schema
    merged = []
    for day in range(3):
        files = [[(START + timedelta(days=day, hours=h), "red" if h % 3 else "blue", 1.0 + h)] for h in range(3)]
        write_batches(spark, folder("in"), files)
        stream = readers.file_stream(spark, folder("in"), schema, files_per_trigger=1)
        result = running.windowed(BY_COLOR, stream, "2 days", delay="30 days")
        sinks.upsert_results(result, folder("out"), folder("check")).awaitTermination()
        merged.append(sinks.merge_results(spark, folder("out"), keys, folder("merged")))
        assert sinks.merge_results(spark, folder("out"), keys, folder("merged")) == merged[-1]
        got = sinks.latest_results(spark, folder("out"), keys, folder("merged"))
        want = BY_COLOR.run_windowed(spark.read.parquet(folder("in")), "2 days").select(*got.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    assert merged[0] < merged[1] < merged[2]
    read = {f.rsplit("/", 2)[-2] for f in got.inputFiles()}
    versions = sinks._versions(spark, folder("out"), folder("merged")).where(F.col("batch") <= merged[-1])
    assert f"to={merged[-1]}" in read and versions.exceptAll(versions.where(F.col("batch") == merged[-1])).count() == 0


def test_stream_without_input_leaves_an_empty_table(spark, folder):
    spark.createDataFrame([], ROWS).write.parquet(folder("in"))
    stream = readers.file_stream(spark, folder("in"), spark.createDataFrame([], ROWS).schema)
    sinks.upsert_results(running.windowed(BY_COLOR, stream, "1 day", delay="1 day"), folder("out"), folder("check")).awaitTermination()
    keys = ["window_start", "window_end", "key"]
    assert sinks.merge_results(spark, folder("out"), keys, folder("merged")) is None
    got = sinks.latest_results(spark, folder("out"), keys, folder("merged"))
    assert got.count() == 0 and "mean" in got.columns


def test_relay_and_fan_out(spark, folder):
    write_batches(spark, folder("in"), [[(START, "red", 1.0)], [(START, "blue", None)]])
    schema = spark.createDataFrame([], ROWS).schema
    stream = readers.file_stream(spark, folder("in"), schema)
    sinks.relay(stream, folder("out"), folder("c1")).awaitTermination()
    assert spark.read.parquet(folder("out")).count() == 2
    sinks.fan_out(stream, [folder("a"), folder("b")], folder("c2")).awaitTermination()
    assert [spark.read.parquet(folder(x)).count() for x in "ab"] == [2, 2]


def test_epoch_release_over_several_batches(spark, folder):
    rows = [  # batch, node, at, kind, epoch, item
        (0, 1, 1, "message", 100, 10),  # before any epoch: held
        (0, 1, 2, "message", 50, 11),
        (1, 1, 10, "set", 100, None),  # releases 10, drops 11
        (1, 1, 11, "message", 100, 12),  # delivered at once
        (1, 1, 12, "message", 50, 13),  # past: dropped
        (1, 1, 13, "message", 200, 14),  # future: held
        (2, 1, 20, "hold", 100, None),
        (2, 1, 21, "message", 100, 15),  # held, then past
        (2, 1, 22, "message", 300, 16),  # held through the next epoch
        (3, 1, 30, "set", 200, None),  # releases 14
        (3, 2, 31, "message", 200, 17),  # another node is still holding
        (4, 1, 40, "set", 300, None),  # releases 16
    ]
    schema = "batch long, node long, at long, kind string, epoch long, item long"
    for b in range(5):
        spark.createDataFrame([r for r in rows if r[0] == b], schema).coalesce(1).write.mode("append").parquet(folder("in"))
    stream = readers.file_stream(spark, folder("in"), spark.read.parquet(folder("in")).schema, files_per_trigger=1)
    messages = stream.where("kind = 'message'").select("node", "at", "epoch", "item")
    control = stream.where("kind <> 'message'").select("node", "at", "kind", "epoch")
    released = release_by_epoch(messages, control, slots=2)
    sinks.append_rows(released, folder("out"), folder("check")).awaitTermination()
    got = {(r["node"], r["item"], r["released"]) for r in spark.read.parquet(folder("out")).collect()}
    assert got == {(1, 10, 10), (1, 12, 11), (1, 14, 30), (1, 16, 40)}


def test_worker_code_needs_no_installed_package(tmp_path):
    plain = StructType().add("key", "string").add("value", "long")
    for thing in (EpochGate(), _fold_tasks(max, plain, 4)):
        (tmp_path / "thing").write_bytes(cloudpickle.dumps(thing))
        code = f"import pickle; pickle.load(open({str(tmp_path / 'thing')!r}, 'rb'))"
        done = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, env={"PATH": ""})
        assert done.returncode == 0, done.stderr


def test_reader_options():
    kafka = readers.kafka_options("a:1,b:2", ["t1", "t2"])
    assert (kafka["subscribe"], kafka["startingOffsets"]) == ("t1,t2", "latest")
    topics = [("a:1", "t2"), ("b:1", "t1"), ("a:1", "t1"), ("a:1", "t2")]
    assert readers.topics_by_broker(topics) == {"a:1": ["t1", "t2"], "b:1": ["t1"]}
    jdbc = readers.jdbc_options("jdbc:x", "posx", 0, 1000, 8)
    assert (jdbc["partitionColumn"], jdbc["numPartitions"], jdbc["upperBound"]) == ("node", "8", "1000")


def test_files_and_reports(spark, folder):
    spark.createDataFrame([(1, 2.0, 3.0)], READING).write.parquet(folder("readings"))
    assert readers.status_files(spark, folder("readings"), READING).first()["reading"] == 3.0
    assert "acceleration" in STATUS.names
    sinks.write_csv(spark.range(3).withColumn("count", F.lit(1)), folder("log"))
    assert spark.read.option("header", "true").csv(folder("log")).count() == 3
    sinks.save_results(spark.range(2), folder("runs"), "first")
    sinks.save_results(spark.range(2), folder("runs"), "second")
    assert spark.read.json(folder("runs")).where("run = 'second'").count() == 2


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


class _Session:
    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master = master
        self.conf = self
        self.folder = folder

    def get(self, name, default=None):
        return self.folder or default

    def getConf(self):
        return self


def test_shared_folder_is_local_only_in_local_mode():
    assert shared_dir(_Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert "fleetfold-" in shared_dir(_Session("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(_Session("yarn"))


def test_shuffle_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10**12) == 7451
        assert size_shuffles(spark, 0) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_beyond_the_exact_range_of_doubles_are_released_unchanged(spark, folder):
    big = 2**53 + 1
    spark.createDataFrame([(1, 5, 100, big)], "node long, at long, epoch long, item long").write.parquet(folder("messages"))
    spark.createDataFrame([(1, 1, "set", 100)], "node long, at long, kind string, epoch long").write.parquet(folder("control"))
    streams = [readers.file_stream(spark, folder(n), spark.read.parquet(folder(n)).schema) for n in ("messages", "control")]
    sinks.append_rows(release_by_epoch(*streams), folder("out"), folder("check")).awaitTermination()
    assert [r.item for r in spark.read.parquet(folder("out")).collect()] == [big]


def test_a_run_saved_twice_is_kept_once(spark, folder):
    for run in ("first", "second", "first"):
        sinks.save_results(spark.range(2), folder("runs"), run)
    counts = spark.read.json(folder("runs")).groupBy("run").count().collect()
    assert {(r["run"], r["count"]) for r in counts} == {("first", 2), ("second", 2)}


def test_stream_queries_read_a_table_that_is_a_folder(spark, sf_dir, folder):
    import __spark_entry__ as entry

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(folder("table") + "/events.parquet")
    for name in ("relay_copy", "stream_windowed_speed_avg"):
        whole, parts = (entry.queries()[name](spark, d) for d in (sf_dir, folder("table")))
        assert whole.count() == parts.count() > 0 and whole.exceptAll(parts.select(*whole.columns)).count() == 0
