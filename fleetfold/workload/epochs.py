"""Epochs, windows and diffusion averaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.functions.scalars import epoch_start, fixed_units
from fleetfold.operators import audit, diffusion, epoch, reduce
from fleetfold.plans.functions import FunctionQuery
from fleetfold.plans.spec import MapReduceQuery, run_mixed, run_tagged
from fleetfold.session import cut_lineage
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query, stock
from fleetfold.workload.tables import AVERAGE, ROUNDS, TOTAL, check

PERIODS = (2, 7, 15)


@query("epoch_assign", check("SELECT event_id, " + ", ".join(
    f"date_trunc('second', ts) - to_seconds(second(ts) % {p}) AS epoch_{p}" for p in PERIODS) + " FROM status"))
def epoch_assign(spark, sf_dir):
    return t.status(spark, sf_dir).select("event_id", *[epoch_start("ts", p).alias(f"epoch_{p}") for p in PERIODS])


@query("epoch_route", check("""SELECT event_id, CASE WHEN e = c THEN 'deliver' WHEN e > c THEN 'buffer' ELSE 'drop' END
    AS route FROM (SELECT event_id, date_trunc('hour', ts) AS e, TIMESTAMP '2024-01-15 12:00:00' AS c FROM status)"""))
def epoch_route(spark, sf_dir):
    current = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return t.status(spark, sf_dir).select("event_id", epoch.route(F.date_trunc("hour", "ts"), current).alias("route"))


_PARTS = """parts AS (SELECT date_trunc('hour', ts) AS epoch, node, arg_max(units, ts) AS units
    FROM status GROUP BY 1, 2)"""


def _parts(spark, sf_dir):
    rows = t.status(spark, sf_dir).withColumn("epoch", F.date_trunc("hour", "ts"))
    return epoch.contributions(rows, "mph", "ts")


@query("epoch_avg", check(f"SELECT epoch, {TOTAL} / COUNT(*) AS average FROM parts GROUP BY epoch", more=_PARTS))
def epoch_avg(spark, sf_dir):
    return epoch.epoch_average(_parts(spark, sf_dir), digits=4)


@query("epoch_sum", check(f"SELECT epoch, {TOTAL} AS total FROM parts GROUP BY epoch", more=_PARTS))
def epoch_sum(spark, sf_dir):
    return epoch.epoch_sum(_parts(spark, sf_dir), digits=4)


@query("epoch_count", check("SELECT epoch, COUNT(*) AS nodes FROM parts GROUP BY epoch", more=_PARTS))
def epoch_count(spark, sf_dir):
    return epoch.epoch_count(_parts(spark, sf_dir))


@query("epoch_result_pivot", check("""SELECT epoch, concat('LogOutput/', kind, '-', node, '/output.log') AS path,
    value AS speed, COALESCE(total, 0.0) AS count FROM log""", "log"))
def epoch_result_pivot(spark, sf_dir):
    results = audit.results_by_op(audit.parse_results(t.gossip_log(spark, sf_dir)))
    return epoch.result_columns(results, ("epoch", "path"))


@query("windowed_speed_avg", check(f"""SELECT time_bucket(INTERVAL '10 seconds', ts) AS window_start,
    time_bucket(INTERVAL '10 seconds', ts) + INTERVAL '10 seconds' AS window_end,
    'speedAndCount' AS key, {AVERAGE} FROM status GROUP BY 1, 2"""))
def windowed_speed_avg(spark, sf_dir):
    return stock("speed_and_count").run_windowed(t.status(spark, sf_dir), "10 seconds")


TAGGED = (
    MapReduceQuery("by-color", "color", "mph", "average", digits=4),
    MapReduceQuery("fast-only", "'fast'", "mph", "average", "mph > 100D", digits=4),
    MapReduceQuery("by-node", "node", "temperature", "average", digits=4),
)
TAGGED_CHECK = f"""SELECT query_uid, time_bucket(INTERVAL '1 hour', ts) AS window_start,
    time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, key, {AVERAGE} FROM (
        SELECT 'by-color' AS query_uid, color AS key, ts, units FROM status
        UNION ALL SELECT 'fast-only', 'fast', ts, units FROM status WHERE mph > 100
        UNION ALL SELECT 'by-node', CAST(node AS VARCHAR), ts, CAST(temperature * 10000 AS BIGINT) FROM status)
    GROUP BY 1, 2, 3, 4"""


@query("multi_query_reduce", check(TAGGED_CHECK))
def multi_query_reduce(spark, sf_dir):
    return run_tagged(TAGGED, t.status(spark, sf_dir), "1 hour")


MIXED = (
    MapReduceQuery("mean-by-color", "color", "mph", "average", digits=4),
    MapReduceQuery("fast-total", "'fast'", "mph", "sum", "mph > 100D", digits=4),
    MapReduceQuery("coldest", "node", "temperature", "min", "color <> 'red'"),
    MapReduceQuery("last-color", "node", "color", "max"),
    MapReduceQuery("colors", "'all'", "color", "union"),
    MapReduceQuery("first-event", "color", "event_id", "first", order=("ts", "event_id")),
)


def _mixed_part(uid, key, where, number, n, text="NULL", members="NULL"):
    return f"""SELECT '{uid}' AS query_uid, time_bucket(INTERVAL '6 hours', ts) AS window_start, {key} AS key,
        CAST({number} AS DOUBLE) AS number, COUNT({n}) AS n, CAST({text} AS VARCHAR) AS text, CAST({members} AS VARCHAR) AS members
        FROM status WHERE {where} GROUP BY 1, 2, 3"""


MIXED_CHECK = "SELECT *, window_start + INTERVAL '6 hours' AS window_end FROM (" + " UNION ALL ".join([
    _mixed_part("mean-by-color", "color", "true", f"{TOTAL} / COUNT(*)", "mph"),
    _mixed_part("fast-total", "'fast'", "mph > 100", TOTAL, "mph"),
    _mixed_part("coldest", "CAST(node AS VARCHAR)", "color <> 'red'", "MIN(temperature)", "temperature"),
    _mixed_part("last-color", "CAST(node AS VARCHAR)", "true", "NULL", "color", "MAX(color)"),
    _mixed_part("colors", "'all'", "true", "NULL", "color", members="string_agg(DISTINCT color, ',' ORDER BY color)"),
    _mixed_part("first-event", "color", "true", "arg_min(event_id, (ts, event_id))", "event_id")]) + ")"


@query("multi_query_mixed_reduce", check(MIXED_CHECK))
def multi_query_mixed_reduce(spark, sf_dir):
    out = run_mixed(MIXED, t.status(spark, sf_dir), "6 hours")
    return out.withColumn("members", F.array_join("members", ","))


CUSTOM_WINDOWS = """SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start,
    time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end, color, node % 4 AS lane, bit_xor(event_id) AS event_id
    FROM status GROUP BY 1, 2, 3, 4"""


@query("custom_reduce_windowed", check(CUSTOM_WINDOWS))
def custom_reduce_windowed(spark, sf_dir):
    rows = t.status(spark, sf_dir).selectExpr("ts", "color", "node % 4 AS lane", "event_id")
    return reduce.custom_reduce_windowed(rows, ["color", "lane"], "event_id", lambda a, b: a ^ b, "6 hours")


def longest_and_sum(a, b):
    return {"far": max(a["far"], b["far"]), "total": a["total"] + b["total"]}


#: Speeds over 20 in whole hundredths by lane and colour, with Python functions for filter, map and reduction.
LANES = FunctionQuery(
    "lanes", ("node", "color", "mph"), where=lambda f: f["mph"] > 20,
    map=lambda f: f.assign(key=f["color"] + "-" + (f["node"] % 4).astype(str), units=(f["mph"] * 100).round().astype("int64"))
    .assign(value=lambda g: [{"far": u, "total": u} for u in g["units"]])[["key", "value"]],
    key_type="string", value_type="struct<far: bigint, total: bigint>", fold=longest_and_sum)
LANES_CHECK = """SELECT {window}color || '-' || (node % 4) AS key, MAX(CAST(ROUND(mph * 100) AS BIGINT)) AS far,
    CAST(SUM(CAST(ROUND(mph * 100) AS BIGINT)) AS BIGINT) AS total FROM status WHERE mph > 20 GROUP BY ALL"""
LANE_WINDOWS = LANES_CHECK.format(window="""time_bucket(INTERVAL '1 day', ts) AS window_start,
    time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, """)


@query("function_query", check(LANES_CHECK.format(window="")))
def function_query(spark, sf_dir):
    return LANES.run(t.status(spark, sf_dir)).select("key", "value.*")


@query("function_query_windowed", check(LANE_WINDOWS))
def function_query_windowed(spark, sf_dir):
    return LANES.run_windowed(t.status(spark, sf_dir), "1 day").select("window_start", "window_end", "key", "value.*")


# Speeds enter as whole units, so halving stays exact and both engines agree to the last bit.
def _state(spark, sf_dir, value, weight):
    sums = t.status(spark, sf_dir).groupBy("node").agg(F.sum(fixed_units("mph")).cast("double").alias("total"))
    return cut_lineage(sums.select("node", F.expr(value).alias("value"), F.expr(weight).alias("weight")), "state")


ROOT_ONLY = "CASE WHEN node = 0 THEN 1.0D ELSE 0.0D END"


def _start(value, weight):
    return f"""n AS (SELECT MAX(node) + 1 AS n FROM status), s0 AS (SELECT node, {value} AS value, {weight} AS weight
        FROM (SELECT node, CAST(SUM(units) AS DOUBLE) AS total FROM status GROUP BY node))"""


def _sums_check(value, weight):
    steps = [_start(value, weight)]
    for r in range(ROUNDS):
        steps.append(f"""s{r + 1} AS (SELECT node, SUM(value) AS value, SUM(weight) AS weight FROM (
            SELECT node, CASE WHEN (node * 31 + {r}) % 11 <> 0 THEN value / 2 ELSE value END AS value,
                CASE WHEN (node * 31 + {r}) % 11 <> 0 THEN weight / 2 ELSE weight END AS weight FROM s{r}
            UNION ALL SELECT (node + {2**r}) % n, value / 2, weight / 2 FROM s{r}, n
            WHERE (node * 31 + {r}) % 11 <> 0) GROUP BY node)""")
    return check(f"SELECT node, value, weight, value / NULLIF(weight, 0) AS estimate FROM s{ROUNDS}",
                 more=", ".join(steps))


def _consensus_check(value, weight):
    steps = [_start(value, weight)]
    for r in range(ROUNDS):
        steps.append(f"""s{r + 1} AS (SELECT a.node,
            CASE WHEN b.node IS NOT NULL AND (LEAST(a.node, b.node) * 31 + {r}) % 11 <> 0
                THEN (a.value + b.value) / 2 ELSE a.value END AS value,
            CASE WHEN b.node IS NOT NULL AND (LEAST(a.node, b.node) * 31 + {r}) % 11 <> 0
                THEN (a.weight + b.weight) / 2 ELSE a.weight END AS weight
            FROM s{r} a LEFT JOIN s{r} b ON b.node = xor(a.node, {2**r}))""")
    return check(f"""SELECT node, value, weight, CASE WHEN weight > 0 THEN value / weight ELSE 0.0 END AS estimate
        FROM s{ROUNDS}""", more=", ".join(steps))


_ROOT_SQL = "CASE WHEN node = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("push_sum_rounds", _sums_check("total", "1.0::DOUBLE"))
def push_sum_rounds(spark, sf_dir):
    state = _state(spark, sf_dir, "total", "1.0D")
    return diffusion.push_sum(state, t.sends(state), ROUNDS)


@query("push_sum_total", _sums_check("total", _ROOT_SQL))
def push_sum_total(spark, sf_dir):
    state = _state(spark, sf_dir, "total", ROOT_ONLY)
    return diffusion.push_sum(state, t.sends(state), ROUNDS)


@query("consensus_rounds", _consensus_check("total", "1.0::DOUBLE"))
def consensus_rounds(spark, sf_dir):
    state = _state(spark, sf_dir, "total", "1.0D")
    return diffusion.consensus(state, t.pairs(state), ROUNDS)


@query("consensus_count", _consensus_check("1.0::DOUBLE", _ROOT_SQL))
def consensus_count(spark, sf_dir):
    state = _state(spark, sf_dir, "1.0D", ROOT_ONLY)
    return diffusion.consensus(state, t.pairs(state), ROUNDS)
