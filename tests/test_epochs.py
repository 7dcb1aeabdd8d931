"""Epoch alignment and the algebra of diffusion averaging."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetfold.functions import scalars as S
from fleetfold.operators import diffusion, epoch

STATE = "node long, value double, weight double"
SENDS = "round int, src long, dst long, ok boolean"
PAIRS = "round int, a long, b long, ok boolean"


def estimates(df):
    return {r["node"]: r["estimate"] for r in df.collect()}


@pytest.mark.parametrize("period,want", [(2, 58), (7, 56), (15, 45), (60, 0)])
def test_epochs_restart_each_minute(spark, period, want):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 59, 999999),)], "ts timestamp_ntz")
    got = df.select(S.epoch_start("ts", period).cast("timestamp_ntz").alias("e")).first()["e"]
    assert got == datetime(2024, 1, 1, 0, 0, want)


def test_routing(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "e long, c long")
    assert [r["r"] for r in df.orderBy("e").select(epoch.route("e", "c").alias("r")).collect()] == [
        "drop", "deliver", "buffer"]


def test_push_sum_of_two_nodes(spark):
    state = spark.createDataFrame([(0, 2.0, 1.0), (1, 1.0, 1.0)], STATE)
    sends = spark.createDataFrame([(0, 0, 1, True), (0, 1, 0, True)], SENDS)
    assert estimates(diffusion.push_sum(state, sends, 1)) == {0: 1.5, 1: 1.5}


def test_failed_send_changes_nothing(spark):
    state = spark.createDataFrame([(0, 2.0, 1.0), (1, 1.0, 1.0)], STATE)
    sends = spark.createDataFrame([(0, 0, 1, False)], SENDS)
    assert estimates(diffusion.push_sum(state, sends, 1)) == {0: 2.0, 1: 1.0}


@pytest.mark.parametrize("root_only", [False, True])
def test_push_sum_reaches_the_mean_or_the_sum(spark, root_only):
    n, rounds = 8, 3
    state = spark.createDataFrame([(i, float(i), float(i == 0 or not root_only)) for i in range(n)], STATE)
    sends = spark.createDataFrame([(r, i, (i + 2**r) % n, True) for r in range(rounds) for i in range(n)], SENDS)
    want = 28.0 if root_only else 3.5
    assert estimates(diffusion.push_sum(state, sends, rounds)) == pytest.approx({i: want for i in range(n)})


def test_no_weight_gives_no_estimate(spark):
    state = spark.createDataFrame([(0, 2.0, 0.0)], STATE)
    none = spark.createDataFrame([], SENDS)
    assert estimates(diffusion.push_sum(state, none, 1)) == {0: None}
    assert estimates(diffusion.consensus(state, spark.createDataFrame([], PAIRS), 1)) == {0: 0.0}


@pytest.mark.parametrize("cut_every", [1, 2, 100])
def test_mass_is_conserved_and_cutting_changes_nothing(spark, cut_every):
    n, rounds = 10, 4
    state = spark.createDataFrame([(i, i * 1.25, 1.0) for i in range(n)], STATE)
    sends = spark.createDataFrame(
        [(r, i, (i * 3 + r) % n, (i + r) % 4 != 0) for r in range(rounds) for i in range(n)], SENDS)
    pairs = spark.createDataFrame(
        [(r, i, i ^ (1 << r), (i + r) % 3 != 0) for r in range(rounds) for i in range(n) if i < i ^ (1 << r) < n], PAIRS)
    for result in (diffusion.push_sum(state, sends, rounds, cut_every), diffusion.consensus(state, pairs, rounds, cut_every)):
        rows = result.collect()
        assert len(rows) == n
        assert sum(r["value"] for r in rows) == pytest.approx(56.25)
        assert sum(r["weight"] for r in rows) == pytest.approx(10.0)


def test_consensus(spark):
    state = spark.createDataFrame([(0, 2.0, 1.0), (1, 1.0, 1.0), (2, 9.0, 1.0)], STATE)
    met = spark.createDataFrame([(0, 0, 1, True)], PAIRS)
    assert estimates(diffusion.consensus(state, met, 1)) == {0: 1.5, 1: 1.5, 2: 9.0}
    aborted = spark.createDataFrame([(0, 0, 1, False)], PAIRS)
    assert estimates(diffusion.consensus(state, aborted, 1)) == {0: 2.0, 1: 1.0, 2: 9.0}


def test_consensus_session_ids_do_not_meet_lone_nodes(spark):
    state = spark.createDataFrame([(5, 2.0, 1.0), (7, 4.0, 1.0), (6, 9.0, 1.0)], STATE)
    pairs = spark.createDataFrame([(0, 6, 7, True)], PAIRS)
    assert estimates(diffusion.consensus(state, pairs, 1)) == {5: 2.0, 6: 6.5, 7: 6.5}


def test_result_columns(spark):
    rows = [("e", 1, "avg", 4.5), ("e", 1, "sum", 10.0), ("e", 2, "avg", 3.0), ("e", 3, "other", 1.0)]
    df = spark.createDataFrame(rows, "epoch string, node long, op string, value double")
    got = {r["node"]: (r["speed"], r["count"]) for r in epoch.result_columns(df).collect()}
    assert got == {1: (4.5, 10.0), 2: (3.0, 0.0), 3: (0.0, 0.0)}


def test_scalars(spark):
    df = spark.createDataFrame([("1,2,3", 4.0, 0.0), ("1,2", None, 2.0), ("1,2,3,4", 2.5, 1.0), ("a,2,3", 3.5, 1.0)],
                               "t string, v double, w double")
    rows = df.select(S.triple("t").alias("t"), S.safe_quotient("v", "w").alias("q"), S.percent_error("v", "w").alias("p"),
                     S.rounded_count("v").alias("n"), S.octets("t", "v").alias("o")).collect()
    assert [r["t"] and tuple(r["t"]) for r in rows] == [(1.0, 2.0, 3.0), None, None, None]
    assert [r["q"] for r in rows] == [0.0, None, 2.5, 3.5]
    assert [r["p"] for r in rows] == [None, None, 150.0, 250.0]
    assert [r["n"] for r in rows] == [4, 1, 3, 4]
    assert [r["o"] for r in rows] == [8, 3, 10, 8]
    assert df.select(F.max(S.seconds_to_ms("w")).alias("m")).first()["m"] == 2000


def test_epochs_before_1970_start_on_their_minute(spark):
    row = spark.sql("SELECT TIMESTAMP'1969-12-31 23:59:47' AS ts").select(S.epoch_start("ts", 10).cast("string")).first()
    assert row[0] == "1969-12-31 23:59:40"
