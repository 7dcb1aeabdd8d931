"""Boxes, regions and queries that apply in some places."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fleetfold.operators import geo
from fleetfold.operators.messages import concat_sources
from fleetfold.operators.reduce import reduce_by_key
from fleetfold.schema import REGION
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query, stock
from fleetfold.workload.tables import AVERAGE, check


def _filtered(name, box):
    return check(f"""SELECT '{name}' AS key, {AVERAGE} FROM status
        WHERE lat BETWEEN {box.lat_min} AND {box.lat_max} AND lon BETWEEN {box.lon_min} AND {box.lon_max}""")


@query("geo_filtered_dense", _filtered("dense", geo.DENSE_BOX))
def geo_filtered_dense(spark, sf_dir):
    return stock("geo_filtered_dense").run(t.status(spark, sf_dir))


@query("geo_filtered_sparse", _filtered("sparse", geo.SPARSE_BOX))
def geo_filtered_sparse(spark, sf_dir):
    return stock("geo_filtered_sparse").run(t.status(spark, sf_dir))


def _region_rows(boxes):
    return [(i, b.rid, b.lat_min, b.lat_max, b.lon_min, b.lon_max) for i, b in enumerate(boxes)]


def _region_twin(boxes):
    rows = ", ".join(f"({i}, '{r}', {a}, {b}, {c}, {d})" for i, r, a, b, c, d in _region_rows(boxes))
    return f"regions AS (SELECT * FROM (VALUES {rows}) v(ord, rid, lat_min, lat_max, lon_min, lon_max))"


_NEAREST = """placed AS (SELECT s.event_id, ANY_VALUE(s.units) AS units, arg_min(r.rid, r.ord) AS rid
    FROM status s LEFT JOIN regions r ON s.lat BETWEEN r.lat_min AND r.lat_max
    AND s.lon BETWEEN r.lon_min AND r.lon_max GROUP BY s.event_id)"""


def _mapped(boxes):
    return check(f"SELECT rid AS key, {AVERAGE} FROM placed WHERE rid IS NOT NULL GROUP BY rid",
                 more=_region_twin(boxes) + ", " + _NEAREST)


def _with_region(spark, sf_dir, boxes):
    regions = spark.createDataFrame(_region_rows(boxes), REGION)
    return geo.map_regions(t.status(spark, sf_dir), regions)


def _region_average(placed):
    hit = placed.where(F.col("rid").isNotNull())
    return reduce_by_key(hit, [F.col("rid").alias("key")], "average", "mph", digits=4)


@query("geo_mapped_dense", _mapped(geo.DENSE_REGIONS))
def geo_mapped_dense(spark, sf_dir):
    return _region_average(_with_region(spark, sf_dir, geo.DENSE_REGIONS))


@query("geo_mapped_sparse", _mapped(geo.SPARSE_REGIONS))
def geo_mapped_sparse(spark, sf_dir):
    return stock("geo_mapped_sparse").run(t.status(spark, sf_dir))


@query("geo_unmatched_dense", check("SELECT event_id FROM placed WHERE rid IS NULL",
                                    more=_region_twin(geo.DENSE_REGIONS) + ", " + _NEAREST))
def geo_unmatched_dense(spark, sf_dir):
    placed = _with_region(spark, sf_dir, geo.DENSE_REGIONS)
    return placed.where(F.col("rid").isNull()).select("event_id")


_HOMES = """regions AS (SELECT node AS ord, concat('home-', node) AS rid, MIN(lat) AS lat_min,
    MIN(lat) + 40 * (1 + node % 9) AS lat_max, MIN(lon) AS lon_min, MIN(lon) + 500 * (1 + node % 4) AS lon_max
    FROM status GROUP BY node)"""


def _homes(spark, sf_dir):
    return t.status(spark, sf_dir).groupBy("node").agg(F.min("lat").alias("lat_min"), F.min("lon").alias("lon_min")).selectExpr(
        "CAST(node AS INT) AS ord", "concat('home-', node) AS rid", "lat_min", "lat_min + 40 * (1 + node % 9) AS lat_max",
        "lon_min", "lon_min + 500 * (1 + node % 4) AS lon_max")


@query("geo_mapped_homes", check(f"SELECT rid AS key, {AVERAGE} FROM placed WHERE rid IS NOT NULL GROUP BY rid",
                                 more=_HOMES + ", " + _NEAREST))
def geo_mapped_homes(spark, sf_dir):
    return _region_average(geo.map_regions(t.status(spark, sf_dir), _homes(spark, sf_dir)))


# Six overlapping activations, used in both engines.
_SPECS = (
    ("west-early", 40000.0, 50000.0, 100000.0, 114000.0, "2024-01-01", "2024-01-15"),
    ("west-late", 40000.0, 50000.0, 100000.0, 114000.0, "2024-01-15", "2024-02-01"),
    ("centre", 45000.0, 55000.0, 103000.0, 110000.0, "2024-01-05", "2024-01-25"),
    ("south", 40000.0, 60000.0, 100000.0, 104000.0, "2024-01-01", "2024-02-01"),
    ("point", 50500.0, 50500.0, 100000.0, 114000.0, "2024-01-01", "2024-02-01"),
    ("one-day", 40000.0, 60000.0, 100000.0, 114000.0, "2024-01-10", "2024-01-11"),
)
_SPEC_TYPE = ("query_id string, lat_min double, lat_max double, lon_min double, lon_max double, "
              "from_ts timestamp_ntz, to_ts timestamp_ntz")
_SPEC_TWIN = "specs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{q}', {a}, {b}, {c}, {d}, TIMESTAMP '{f}', TIMESTAMP '{e}')" for q, a, b, c, d, f, e in _SPECS
) + ") v(query_id, lat_min, lat_max, lon_min, lon_max, from_ts, to_ts))"
_ACTIVE = """SELECT s.event_id, q.query_id FROM status s JOIN specs q
    ON s.lat BETWEEN q.lat_min AND q.lat_max AND s.lon BETWEEN q.lon_min AND q.lon_max
    AND s.ts >= q.from_ts AND s.ts < q.to_ts"""


@query("active_queries", check(_ACTIVE, more=_SPEC_TWIN))
def active_queries(spark, sf_dir):
    rows = [(q, a, b, c, d, datetime.fromisoformat(f), datetime.fromisoformat(e)) for q, a, b, c, d, f, e in _SPECS]
    specs = spark.createDataFrame(rows, _SPEC_TYPE)
    return geo.active_queries(t.status(spark, sf_dir).select("event_id", "lat", "lon", "ts"), specs).select(
        "event_id", "query_id")


_HOME_SPECS = _HOMES.replace("regions AS", "homes AS") + """, specs AS (
    SELECT rid AS query_id, lat_min, lat_max, lon_min, lon_max,
    TIMESTAMP '2024-01-01' AS from_ts, TIMESTAMP '2024-01-20' AS to_ts FROM homes)"""


@query("active_home_queries", check(_ACTIVE, more=_HOME_SPECS))
def active_home_queries(spark, sf_dir):
    specs = _homes(spark, sf_dir).selectExpr(
        "rid AS query_id", "lat_min", "lat_max", "lon_min", "lon_max",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS from_ts", "TIMESTAMP_NTZ'2024-01-20 00:00:00' AS to_ts")
    return geo.active_queries(t.status(spark, sf_dir).select("event_id", "lat", "lon", "ts"), specs).select(
        "event_id", "query_id")


@query("node_queries", check("""SELECT s.event_id, a.query_id FROM status s JOIN (
    SELECT DISTINCT node, 'speed' AS query_id FROM status
    UNION ALL SELECT DISTINCT node, 'fast' FROM status WHERE mph > 200) a ON s.node = a.node"""))
def node_queries(spark, sf_dir):
    rows = t.status(spark, sf_dir)
    every, fast = (d.select("node").distinct() for d in (rows, rows.where("mph > 200")))
    assignments = concat_sources({"speed": every, "fast": fast}, label="query_id")
    return rows.select("event_id", "node").join(assignments, "node").select("event_id", "query_id")
