"""Status rows, reading tables and cluster traffic."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetfold.functions.scalars import octets
from fleetfold.operators import cluster
from fleetfold.operators import timeseries as ts
from fleetfold.operators.status import assemble_status, positions_as_status, status_from_map

GOOD = {"id": "1", "lat": "0", "lon": "0", "color": "red", "temperature": "27", "humidity": "0",
        "tireDistance": "5", "groundDistance": "12", "mph": "0", "acceleration": "0,0,0"}
MAPS = "n long, fields map<string,string>"


def test_fixed_status(spark):
    good, bad = status_from_map(spark.createDataFrame([(1, GOOD)], MAPS))
    row = good.first()
    assert (row["n"], row["id"], row["temperature"], row["groundDistance"], row["color"]) == (1, 1, 27.0, 12.0, "red")
    assert tuple(row["acceleration"]) == (0.0, 0.0, 0.0)
    assert bad.count() == 0


@pytest.mark.parametrize("change,field", [
    ({"id": "1.5"}, "id"), ({"mph": "fast"}, "mph"), ({"color": "pink"}, "color"), ({"acceleration": "0,0"}, "acceleration"),
    ({"acceleration": "0,0,0,0"}, "acceleration"), ({"acceleration": "0,x,0"}, "acceleration"),
    ({"humidity": None}, "humidity"), ({"lat": None, "lon": None}, "lat"), ({"acceleration": None}, "acceleration"),
    ({"color": None}, "color"),
])
def test_bad_status_is_rejected_with_its_field(spark, change, field):
    fields = {k: v for k, v in {**GOOD, **change}.items() if v is not None}
    good, bad = status_from_map(spark.createDataFrame([(1, fields), (2, GOOD)], MAPS))
    assert [r["n"] for r in good.collect()] == [2]
    assert [(r["n"], r["bad_field"]) for r in bad.collect()] == [(1, field)]


def test_map_that_is_absent_is_rejected(spark):
    good, bad = status_from_map(spark.createDataFrame([(1, None)], MAPS))
    assert good.count() == 0 and bad.count() == 1


def test_assembly_takes_the_last_reading_and_ignores_other_types(spark):
    rows = [(1, 1, "mph", 99.0, 1), (1, 1, "mph", 100.0, 2), (1, 1, "lat", 10.0, 1), (1, 1, "lon", 10.0, 1),
            (1, 1, "Int", 1.0, 9), (1, 1, "Double", 99.0, 9), (2, 1, "mph", 5.0, 1)]
    df = spark.createDataFrame(rows, "node long, ts long, type string, reading double, seq long")
    whole, lacking = assemble_status(df, ["mph", "lat", "lon"])
    assert [tuple(r) for r in whole.collect()] == [(1, 1, 100.0, 10.0, 10.0)]
    assert [r["node"] for r in lacking.collect()] == [2]


@pytest.fixture(scope="module")
def readings(spark):
    def table(rows):
        return spark.createDataFrame(rows, "node long, timestamp double, reading double")

    x = table([(1, 1.0, 5.0), (1, 2.0, 6.0), (2, 1.0, 7.0), (3, 0.5, 8.0), (4, 9.0, 1.0)])
    y = table([(1, 1.0, 50.0), (1, 2.0, 60.0), (2, 1.0, 70.0), (3, 0.5, 80.0)])
    speed = table([(1, 2.0, 0.6), (2, 1.0, 0.7), (3, 0.5, 0.8), (4, 9.0, 1.0)])
    return x, y, speed


def test_positions(readings):
    positions = ts.node_positions(*readings)
    assert {(r["node"], r["timestamp"]) for r in positions.collect()} == {(1, 2.0), (2, 1.0), (3, 0.5)}
    assert {r["node"] for r in ts.concurrent_nodes(positions, 1).collect()} == {2, 3}
    assert {r["node"] for r in ts.concurrent_nodes(positions, 3).collect()} == set()
    assert ts.concurrent_nodes(positions, 99).count() == 0
    row = positions_as_status(positions.where("node = 2")).first()
    assert (row["lat"], row["lon"], row["mph"]) == (7.0, 70.0, 0.7)


def test_time_queries(readings):
    x = readings[0]
    assert ts.downsample(x, 1.0).count() == 4
    assert tuple(ts.time_range(x, 1.0).first()) == (1.0, 9.0)
    assert [r["node"] for r in ts.first_nodes(x, 2).collect()] == [1, 2]
    assert [r["node"] for r in ts.for_node(x, 4).collect()] == [4]
    assert ts.for_node(x, 4, other=True).count() == 4


def test_timing_queue_blocks(spark):
    df = spark.createDataFrame([(n, 1.0) for n in range(25)] + [(3, 0.5), (3, 0.5)], "node long, timestamp double")
    rows = ts.timing_queue(df, block=10).collect()
    assert [(r["timestamp"], len(r["nodes"])) for r in rows] == [(0.5, 1), (1.0, 10), (1.0, 10), (1.0, 5)]
    assert sorted(n for r in rows if r["timestamp"] == 1.0 for n in r["nodes"]) == list(range(25))


def test_layout_by_node(readings, tmp_path):
    laid = ts.cluster_by_node(readings[0], 2)
    assert laid.rdd.getNumPartitions() <= 2 and laid.count() == 5


def test_head_or_self(spark):
    df = spark.createDataFrame([(1, 10), (2, 10)], "node long, t long")
    heads = spark.createDataFrame([(1, 10, 7), (2, 9, 8)], "node long, t long, head long")
    assert {(r["node"], r["head"]) for r in ts.head_or_self(df, heads, "t").collect()} == {(1, 7), (2, 2)}


def test_two_levels_equal_one(spark):
    rows = [(n, datetime(2024, 1, 1 + n % 3), n * 0.1) for n in range(50)]
    df = spark.createDataFrame(rows, "node long, ts timestamp_ntz, mph double")
    heads = spark.createDataFrame([(n, datetime(2024, 1, 1), n % 4) for n in range(0, 50, 2)],
                                  "node long, ts timestamp_ntz, head long")
    routed = cluster.assign_heads(df, heads)
    mapped = routed.select("head", "ts", F.lit("k").alias("key"), F.col("mph").alias("value"))
    two = cluster.two_level_average(mapped, ["ts"], digits=4).first()
    assert (two["total"], two["n"]) == (122.5, 50)
    per_head = cluster.per_cluster_reduce(mapped, "average", digits=4)
    assert per_head.agg(F.sum("n")).first()[0] == 50
    assert {r["head"] for r in per_head.collect()} == set(range(4)) | {n for n in range(50) if n % 2}


def test_traffic(spark):
    rows = [(1, "kk", 1.0, "vvvv"), (1, "kk", 2.0, None), (2, "k", 3.0, "é")]
    sent = spark.createDataFrame(rows, "head long, key string, value double, text string")
    got = {r["head"]: (r["raw_bytes"], r["reduced_bytes"], r["saved_percent"]) for r in cluster.traffic_savings(
        sent, "sum", octets("key", "text"), F.col("value").cast("int").cast("string")).collect()}
    assert got == {1: (8, 3, 62.5), 2: (3, 2, 33.333333)}
    sizes = cluster.relay_bytes(sent, "head", value="text").collect()
    assert {(r["head"], r["messages"], r["bytes"]) for r in sizes} == {(1, 2, 8), (2, 1, 3)}
