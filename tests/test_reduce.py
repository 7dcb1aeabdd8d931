from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetfold import MapReduceQuery, named_query, query_names
from fleetfold.operators import messages as M
from fleetfold.operators import opaque, reduce
from fleetfold.plans.spec import run_tagged
from fleetfold.streaming.queries import event_time
from fleetfold.workload import tables as t


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("a", 1.5, 1), ("a", 2.5, 2), ("b", 7.0, 3), (None, 4.0, 4), (None, 6.0, 5)]
    return spark.createDataFrame(rows, "key string, value double, at long")


def by_key(df, column="value"):
    return {r["key"]: r[column] for r in df.collect()}


def test_reductions(pairs):
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "sum")) == {"a": 4.0, "b": 7.0, None: 10.0}
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "min")) == {"a": 1.5, "b": 7.0, None: 4.0}
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "max")) == {"a": 2.5, "b": 7.0, None: 6.0}
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "average"), "mean") == {"a": 2.0, "b": 7.0, None: 5.0}
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "first", order=["at"])) == {"a": 1.5, "b": 7.0, None: 4.0}
    assert by_key(reduce.reduce_by_key(pairs, ["key"], "union")) == {"a": [1.5, 2.5], "b": [7.0], None: [4.0, 6.0]}


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3] * 1000 + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    sums = {reduce.full_reduce(df.repartition(n), "sum", digits=4).first()["value"] for n in (1, 3, 7)}
    assert sums == {1000000600.0}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "key string, value double")
    assert reduce.reduce_by_key(empty, ["key"], "average").collect() == []
    assert reduce.full_reduce(empty, "sum").first()["value"] is None
    row = reduce.full_reduce(empty, "average").first()
    assert row["n"] == 0 and row["mean"] is None


def test_bad_declarations():
    with pytest.raises(ValueError):
        reduce.aggregates("product")
    with pytest.raises(ValueError):
        reduce.aggregates("first")
    with pytest.raises(ValueError):
        MapReduceQuery("q", "k", "v", "product")
    with pytest.raises(ValueError):
        MapReduceQuery("q", "k", "v").aggregates()
    with pytest.raises(KeyError):
        named_query("nothing")


def test_map_and_reduce_differ_and_equal_declarations_agree():
    assert MapReduceQuery("q", "k", "v") != MapReduceQuery("q", "k", "v", "sum")
    assert MapReduceQuery("q", "k", "v", "sum") == MapReduceQuery("q", "k", "v", "sum")
    assert len({named_query(n).id for n in query_names()}) == len(query_names())


@pytest.mark.parametrize("partitions,fan_in,flush", [(1, 1, 50_000), (7, 2, 2), (16, 64, 50_000)])
def test_custom_reduce_equals_brute_force(spark, monkeypatch, partitions, fan_in, flush):
    monkeypatch.setattr(reduce, "FLUSH_KEYS", flush)
    rows = [(None if i % 5 == 0 else f"k{i % 4}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, value long").repartition(partitions)
    want = defaultdict(int)
    for k, v in rows:
        want[k] ^= v
    got = reduce.custom_reduce(df, "key", "value", lambda a, b: a ^ b, fan_in).collect()
    assert len(got) == len(want) and {r["key"]: r["value"] for r in got} == dict(want)


def test_custom_reduce_passes_a_lone_value_through(spark):
    def never(a, b):
        raise AssertionError("a lone value is not reduced")

    df = spark.createDataFrame([("a", 1), ("b", None)], "key string, value long")
    assert by_key(reduce.custom_reduce(df, "key", "value", never)) == {"a": 1, "b": None}


def test_custom_reduce_of_structs(spark):
    df = spark.createDataFrame([("a", (1.0, 1)), ("a", (2.0, 1)), ("b", (5.0, 1))],
                               "key string, value struct<s:double,n:long>")
    got = reduce.custom_reduce(df, "key", "value", lambda a, b: {"s": a["s"] + b["s"], "n": a["n"] + b["n"]})
    assert {r["key"]: tuple(r["value"]) for r in got.collect()} == {"a": (3.0, 2), "b": (5.0, 1)}


def test_opaque_map_and_filter(spark):
    df = spark.range(10)
    kept = opaque.filter_batches(df, lambda b: b["id"] % 2 == 0)
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 4, 6, 8]
    doubled = opaque.map_batches(kept, lambda b: b.assign(id=b["id"] * 2), "id long")
    assert sorted(r["id"] for r in doubled.collect()) == [0, 4, 8, 12, 16]


def test_latest_and_earliest_row(pairs, spark):
    assert reduce.latest_row(pairs, ["at"]).first()["at"] == 5
    assert {r["at"] for r in reduce.earliest_row(pairs, ["at"], ["key"]).collect()} == {1, 3, 4}
    assert reduce.latest_row(pairs.limit(0), ["at"]).collect() == []


def test_set_changes(spark):
    before = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "q string")
    after = spark.createDataFrame([("b",), ("c",), (None,)], "q string")
    got = {(r["q"], r["change"]) for r in reduce.set_changes(before, after, ["q"]).collect()}
    assert got == {("a", "stopped"), ("c", "started")}
    assert reduce.set_changes(before, before, ["q"]).count() == 0


def test_tagged_queries_equal_single_ones(spark, sf_dir):
    rows = t.status(spark, sf_dir)
    one = MapReduceQuery("one", "color", "mph", "average", digits=4)
    two = MapReduceQuery("two", "'all'", "mph", "average", "mph > 50D", digits=4)
    both = run_tagged([one, two], rows, "1 day")
    for q in (one, two):
        alone = q.run_windowed(rows, "1 day")
        mine = both.where(F.col("query_uid") == q.id).select(*alone.columns)
        assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0
    with pytest.raises(ValueError):
        run_tagged([one, one], rows, "1 day")
    with pytest.raises(ValueError):
        run_tagged([one, MapReduceQuery("s", "color", "mph", "sum")], rows, "1 day")


def test_flagship_scan_reads_one_column(spark, sf_dir):
    plan = named_query("speed_and_count").run(t.status(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:double>" in plan


def test_messages(spark):
    rows = [(1, 1.0, "q", "q", False), (2, 2.0, "q", "r", False), (3, 3.0, None, None, True), (4, None, "r", "r", None)]
    df = spark.createDataFrame(rows, "key long, value double, key_uid string, value_uid string, is_canary boolean")
    assert {r["key"] for r in M.drop_canaries(df).collect()} == {1, 2, 4}
    assert {r["key"] for r in M.drop_null_records(df).collect()} == {1, 2, 3}
    assert [r["key"] for r in M.for_query(df, "q").collect()] == [1]
    assert M.for_query(df.where("key <> 2"), "q", strict=True).count() == 1
    with pytest.raises(Exception, match="tags differ"):
        M.for_query(df, "q", strict=True).collect()


def test_envelope_defaults(spark):
    wrapped = M.wrap(spark.range(1).withColumn("v", F.lit("x")), F.col("id"), F.col("v"))
    row = M.unwrap(wrapped, "bigint", "string").first()
    assert (row["key"], row["value"], row["key_uid"], row["is_canary"]) == (0, "x", None, False)
    assert row["created_ms"] > 0


def test_first_status_wins_and_unknown_messages_drop_out(spark):
    sends = spark.createDataFrame([("m",), ("n",)], "uuid string")
    statuses = spark.createDataFrame([("m", 2, "GOOD"), ("m", 1, "BAD"), ("x", 1, "GOOD")],
                                     "uuid string, seq long, status string")
    got = {r["uuid"]: r["status"] for r in M.first_status(sends, statuses).collect()}
    assert got == {"m": "BAD", "n": None}


def test_routing_by_query(spark):
    sent = spark.createDataFrame([("avg", "speed"), ("bad", "bad"), (None, None)], "op string, item string")
    known = spark.createDataFrame([("avg", "speed"), ("avg", "speed")], "op string, item string")
    assert [tuple(r) for r in M.route_by_query(sent, known).collect()] == [("avg", "speed")]
    assert {tuple(r) for r in M.unrouted(sent, known).collect()} == {("bad", "bad"), (None, None)}


def test_event_time_needs_a_stream_or_batch_column(spark, sf_dir):
    df = event_time(t.status(spark, sf_dir))
    assert dict(df.dtypes)["ts"] == "timestamp"


def test_stock_sums_are_plain_sums(spark):
    rows = spark.createDataFrame([(0.00004,)] * 10, "mph double")
    assert named_query("speed_sum").run(rows).first()["value"] == pytest.approx(0.0004)
    odd = spark.createDataFrame([(1.0,), (float("nan"),)], "mph double")
    assert named_query("speed_sum").run(odd).first()["value"] != 1.0


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_set_chunks_hold_every_value_once_in_bounded_rows(spark, chunk):
    rows = [(f"k{i % 3}" if i % 10 else None, i % 90 if i % 17 else None) for i in range(600)]
    parts = reduce.set_chunks(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", chunk).collect()
    got = defaultdict(list)
    for r in parts:
        assert 0 < len(r.v) <= chunk and r.v == sorted(r.v)
        got[r.k] += r.v
    assert len({(r.k, r.part) for r in parts}) == len(parts)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted({v for q, v in rows if q == k and v is not None}) for k in {k for k, _ in rows}}


def test_set_chunks_of_nothing(spark):
    assert reduce.set_chunks(spark.createDataFrame([("a", None)], "k string, v int"), ["k"], "v").count() == 0
