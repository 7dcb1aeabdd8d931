"""Order-dependent operators against brute force, with one hot key."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from fleetfold.operators import scans

START = datetime(2024, 1, 1)


def rows_with_hot_key(n, seed):
    rng = random.Random(seed)
    keys = [0] * (n // 3) + [rng.randint(1, 9) for _ in range(n - n // 3)]
    rng.shuffle(keys)
    return [(k, START + timedelta(seconds=rng.randint(0, 4 * 86400)), i, rng.randint(0, 50))
            for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def events(spark):
    rows = rows_with_hot_key(600, 1)
    return rows, spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v long")


def in_order(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_running_total(events, bucket):
    rows, df = events
    got = {r["id"]: r["total"] for r in scans.running_total(df, ["k"], "ts", "v", "total", ["id"], bucket).collect()}
    want = {}
    for group in in_order(rows).values():
        total = 0
        for row in group:
            total += row[3]
            want[row[2]] = total
    assert got == want


def test_running_total_keeps_null_keys(spark):
    rows = [(None, START, 1, 5), (None, START + timedelta(days=1), 2, 6)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v long")
    got = sorted((r["id"], r["t"]) for r in scans.running_total(df, ["k"], "ts", "v", "t").collect())
    assert got == [(1, 5), (2, 11)]


def test_first_n(events):
    rows, df = events
    got = {r["id"] for r in scans.first_n(df, ["k"], ["ts", "id"], 3).collect()}
    assert got == {row[2] for group in in_order(rows).values() for row in group[:3]}


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_ordered_fold_pieces_join_to_the_whole(events, piece):
    rows, df = events
    texts = df.withColumn("s", F.concat("id", F.lit(";")))
    got = defaultdict(dict)
    for r in scans.ordered_fold(texts, ["k"], "ts", "s", ["id"], piece).collect():
        got[r["k"]][r["piece"]] = r["text"]
    for k, group in in_order(rows).items():
        assert "".join(got[k][p] for p in sorted(got[k])) == "".join(f"{r[2]};" for r in group)
        assert all(t.count(";") <= piece for t in got[k].values())


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "scan"])
def test_as_of(spark, events, strategy):
    rows, df = events
    rng = random.Random(2)
    changes = [(rng.randint(0, 9), START + timedelta(hours=rng.randint(0, 120)), rng.randint(0, 99)) for _ in range(60)]
    changes += [(rows[0][0], rows[0][1], 77)]
    right = spark.createDataFrame(changes, "k long, at timestamp_ntz, head long")
    got = {r["id"]: r["head"] for r in scans.as_of(df, right, "k", "ts", "at", "head", strategy).collect()}
    want = {}
    for k, ts, i, _ in rows:
        past = [(at, head) for key, at, head in changes if key == k and at <= ts]
        want[i] = max(past)[1] if past else None
    assert got == want
    assert None in got.values()


def test_as_of_goes_to_the_scan_when_the_right_side_is_large(spark, events, monkeypatch):
    monkeypatch.setattr(scans, "BROADCAST_ROWS", 3)
    _, df = events
    right = df.select("k", F.col("ts").alias("at"), F.col("v").alias("head"))
    plan = scans.as_of(df, right, "k", "ts", "at", "head")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan.split("== Physical Plan ==")[1]
    a = scans.as_of(df, right, "k", "ts", "at", "head", "scan")
    b = scans.as_of(df, right, "k", "ts", "at", "head", "broadcast")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_as_of_does_not_carry_a_null_change_back(spark):
    left = spark.createDataFrame([(1, START + timedelta(days=3))], "k long, ts timestamp_ntz")
    right = spark.createDataFrame([(1, START, 5), (1, START + timedelta(days=1), None)],
                                  "k long, at timestamp_ntz, head long")
    for strategy in ("broadcast", "scan"):
        assert scans.as_of(left, right, "k", "ts", "at", "head", strategy).first()["head"] is None


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_exact_median(spark, bins):
    rng = random.Random(3)
    groups = {1: [7.0], 2: [1.0, 2.0], 3: [5.0] * 9 + [1.0], 4: [rng.random() for _ in range(101)],
              5: [rng.expovariate(1) for _ in range(200)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, v double")
    counts = scans.value_counts(df, ["k"], "v")
    got = {r["k"]: r["m"] for r in scans.exact_median(counts, ["k"], "v", "m", bins).collect()}
    assert got == pytest.approx({k: median(vs) for k, vs in groups.items()})


def test_exact_lookup_parts_rows(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 1.0), (None, 1.0)], "node long, timestamp double")
    right = spark.createDataFrame([(1, 1.0, 9.0)], "node long, timestamp double, x double")
    hits, misses = scans.exact_lookup(left, right, ["node", "timestamp"])
    assert [r["x"] for r in hits.collect()] == [9.0]
    assert {r["node"] for r in misses.collect()} == {2, None}


@pytest.mark.parametrize("strategy", ["broadcast", "scan"])
def test_as_of_never_matches_nulls(spark, strategy):
    left = spark.createDataFrame([(None, START), (1, None), (1, START)], "k long, ts timestamp_ntz")
    right = spark.createDataFrame([(None, START, 5), (1, None, 6)], "k long, at timestamp_ntz, head long")
    got = scans.as_of(left, right, "k", "ts", "at", "head", strategy).collect()
    assert [r["head"] for r in got] == [None] * 3


def test_number_times(spark):
    df = spark.createDataFrame([(1, 0.25 * i, i) for i in range(40)], "k long, at double, v long")
    got = {r["v"]: r["t"] for r in scans.running_total(df, ["k"], "at", "v", "t", bucket=1.5).collect()}
    assert got == {i: sum(range(i + 1)) for i in range(40)}
    right = spark.createDataFrame([(1, 3.0, 7), (1, 5.0, 8)], "k long, since double, head long")
    heads = {r["v"]: r["head"] for r in scans.as_of(df, right, "k", "at", "since", "head", "scan", 1.0).collect()}
    assert heads == {i: None if i < 12 else 7 if i < 20 else 8 for i in range(40)}


@pytest.mark.parametrize("strategy", ["broadcast", "scan"])
def test_as_of_on_times_in_seconds_without_a_bucket(spark, strategy):
    left = spark.createDataFrame([(1, 10.0), (1, 99_999.5), (2, 5.0)], "node long, at double")
    right = spark.createDataFrame([(1, 9.5, 7), (1, 99_999.0, 8)], "node long, since double, head int")
    rows = scans.as_of(left, right, "node", "at", "since", "head", strategy)
    assert {tuple(r) for r in rows.collect()} == {(1, 10.0, 7), (1, 99_999.5, 8), (2, 5.0, None)}


def test_a_bucket_must_fit_the_type_of_the_time(spark):
    left = spark.createDataFrame([(1, 10.0)], "node long, at double")
    with pytest.raises(ValueError, match="does not fit"):
        scans.as_of(left, left.selectExpr("node", "at AS since", "1 AS head"), "node", "at", "since", "head", bucket="hour")
