"""Queries with Python functions, and several reductions over one scan."""

import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fleetfold import FunctionQuery, MapReduceQuery
from fleetfold.operators import reduce
from fleetfold.plans.spec import run_mixed
from fleetfold.sources import readers
from fleetfold.streaming import queries as running
from fleetfold.streaming import sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])
START = datetime(2024, 1, 1)
TYPE = "ts timestamp, node long, color string, mph double"
ROWS = [(START + timedelta(seconds=11 * i), i % 5 if i % 9 else None, "red" if i % 3 else "blue", i / 4 if i % 10 else None) for i in range(90)]
CLOSING = (datetime(2030, 1, 1), 0, "none", 9.0)


def joined(a, b):
    return {"n": a["n"] + b["n"], "names": sorted({*a["names"], *b["names"]})}


NAMES = FunctionQuery(
    "names", ("node", "color", "mph"), where=lambda f: f["mph"] >= 5,
    map=lambda f: f.assign(key=f["color"], value=[{"n": 1, "names": [str(n)]} for n in f["node"].fillna(-1).astype(int)]),
    key_type="string", value_type="struct<n: bigint, names: array<string>>", fold=joined)


def names(rows):
    out = {}
    for _, node, color, mph in rows:
        if mph is not None and mph >= 5:
            out.setdefault(color, []).append(str(-1 if node is None else node))
    return {k: (len(v), sorted(set(v))) for k, v in out.items()}


def test_function_query(spark):
    df = spark.createDataFrame(ROWS, TYPE).repartition(5)
    got = NAMES.run(df).collect()
    assert {r.key: (r.value.n, r.value.names) for r in got} == names(ROWS)
    assert NAMES == FunctionQuery("names", (), None, "int", "int") and len({NAMES, FunctionQuery("names", (), None, "int", "int")}) == 1
    assert NAMES.mapped(df, keep=["node"]).columns == ["node", "key", "value"]
    with pytest.raises(ValueError):
        FunctionQuery("x", ("node",), NAMES.map, "string", "bigint").run(df)


def test_function_query_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(ROWS, TYPE).write.parquet(path)
    lone = FunctionQuery("lone", ("mph",), lambda f: f.assign(key="k", value=f["mph"]), "string", "double", fold=max)
    plan = lone.mapped(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<mph:double>" in plan


@pytest.mark.parametrize("files", [1, 4])
def test_function_query_in_windows_of_a_stream(spark, tmp_path, files):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    step = -(-len(ROWS) // files)
    for k in range(0, len(ROWS), step):
        spark.createDataFrame(ROWS[k:k + step], TYPE).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([CLOSING], TYPE).coalesce(1).write.mode("append").parquet(path)
    stream = readers.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    folded = NAMES.run_windowed(running.event_time(stream, delay="1 hour"), "2 minutes", slots=3)
    sinks.append_rows(folded, out, check).awaitTermination()
    got = spark.read.parquet(out)
    want = NAMES.run_windowed(spark.createDataFrame(ROWS, TYPE), "2 minutes")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() > 10


def test_custom_reduce_by_several_keys(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, f"k{i % 2}", i) for i in range(100)], "a int, b string, v long").repartition(7)
    got = reduce.custom_reduce(df, ["a", "b"], "v", lambda x, y: x + y, fan_in=2)
    want = df.groupBy("a", "b").agg(F.sum("v").alias("v"))
    assert got.columns == ["a", "b", "v"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_windows_leave_out_rows_without_time(spark):
    rows = spark.createDataFrame([(START, "a", 1), (START + timedelta(minutes=1), "a", 2), (START, "a", 4), (None, "a", 8)], "ts timestamp, k string, v long")
    got = reduce.custom_reduce_windowed(rows, "k", "v", lambda x, y: x | y, "1 minute").collect()
    assert sorted((r.window_start, r.v) for r in got) == [(START, 5), (START + timedelta(minutes=1), 2)]


MIXED = [
    MapReduceQuery("mean", "color", "mph", "average", digits=4), MapReduceQuery("total", "'all'", "node", "sum", "mph > 3", digits=4),
    MapReduceQuery("low", "node", "mph", "min"), MapReduceQuery("high", "'x'", "color", "max"),
    MapReduceQuery("nodes", "color", "node", "union"), MapReduceQuery("first", "color", "struct(node, mph)", "first", order=("ts",)),
]


def test_mixed_reductions_equal_single_queries(spark):
    df = spark.createDataFrame(ROWS, TYPE)
    mixed = run_mixed(MIXED, df, "5 minutes")
    assert mixed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.query_uid, r.window_start, r.key): r for r in mixed.collect()}
    seen = 0
    for q in MIXED:
        for r in q.run_windowed(df, "5 minutes").collect():
            m = got[q.id, r.window_start, None if r.key is None else str(r.key)]
            seen += 1
            if q.reduce == "average":
                assert (m.number, m.n) == (r["mean"], r.n)
            elif q.id == "high":
                assert (m.text, m.number) == (r.value, None)
            elif q.reduce == "union":
                assert m.members == sorted(map(str, r.value))
            elif q.reduce == "first":
                assert (f'"mph":{r.value.mph}' in m.text) == (r.value.mph is not None)
            else:
                assert (m.number, m.text, m.members) == (r.value, None, None)
    assert seen == len(got) > 30


def test_mixed_reductions_refuse_what_has_no_meaning(spark):
    df = spark.createDataFrame(ROWS, TYPE)
    for wrong in ([MIXED[0], MIXED[0]], [MapReduceQuery("m", "color", "mph")],
                  [MIXED[5], MapReduceQuery("second", "color", "mph", "first", order=("node",))]):
        with pytest.raises(ValueError):
            run_mixed(wrong, df, "1 minute")
