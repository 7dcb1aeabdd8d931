"""Vehicle tables derived from the driver's ``events`` table.

Each Spark frame here has a twin of the same name in ``TWINS``, the common
table expressions that the SQL checks start from. Number formats are built
from whole numbers so both engines print the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = 75
ROUNDS = 6
FIRST_DAY = "2024-01-01 00:00:00"

COLOUR = """CASE event_type WHEN 'click' THEN 'red' WHEN 'view' THEN 'green'
    WHEN 'purchase' THEN 'blue' WHEN 'signup' THEN 'white' ELSE 'black' END"""

STATUS_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "node": "user_id",
    "lat": "CAST(40000 + (event_id * 7919) % 20000 AS DOUBLE)",
    "lon": "CAST(100000 + (event_id * 104729) % 14000 AS DOUBLE)",
    "mph": "value",
    "color": COLOUR,
    "temperature": "CAST(get_json_object(props, '$.k') AS DOUBLE)",
    "humidity": "CAST(20 + event_id % 60 AS DOUBLE)",
    "tireDistance": "CAST(event_id % 10 AS DOUBLE)",
    "groundDistance": "CAST(12 + event_id % 5 AS DOUBLE)",
    "acceleration": "named_struct('x', CAST(event_id % 7 - 3 AS DOUBLE), "
                    "'y', CAST(event_id % 5 - 2 AS DOUBLE), 'z', CAST(event_id % 3 - 1 AS DOUBLE))",
}
SIM_TS = "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS DOUBLE) + (event_id % 4) * 0.25D"


def as_status(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{sql} AS {name}" for name, sql in STATUS_COLUMNS.items()])


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_status(spark.read.parquet(f"{sf_dir}/events.parquet"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status(spark, sf_dir).select("node").distinct()


def units_text(units: str, digits: int) -> str:
    """SQL for a whole number of 10**-digits units as decimal text."""
    base = 10**digits
    return f"concat({units} div {base}, '.', lpad({units} % {base}, {digits}, '0'))"


MPH_UNITS = "CAST(rint(mph * 100) AS BIGINT)"


def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textual rows. Very fast vehicles lost an acceleration part, freezing ones their temperature."""
    return status(spark, sf_dir).selectExpr("event_id", f"""map(
        'id', CAST(node AS STRING),
        'lat', CAST(CAST(lat AS BIGINT) AS STRING),
        'lon', CAST(CAST(lon AS BIGINT) AS STRING),
        'mph', {units_text(MPH_UNITS, 2)},
        'color', color,
        'temperature', CASE WHEN temperature = 0 THEN 'cold' ELSE CAST(CAST(temperature AS BIGINT) AS STRING) END,
        'humidity', CAST(CAST(humidity AS BIGINT) AS STRING),
        'tireDistance', CAST(CAST(tireDistance AS BIGINT) AS STRING),
        'groundDistance', CAST(CAST(groundDistance AS BIGINT) AS STRING),
        'acceleration', CASE WHEN mph > 200 THEN '0,0' ELSE concat_ws(',',
            CAST(acceleration.x AS BIGINT), CAST(acceleration.y AS BIGINT), CAST(acceleration.z AS BIGINT)) END
    ) AS fields""")


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """posx, posy and speed. White vehicles have no y sensor; slow ones report no speed."""
    timed = status(spark, sf_dir).withColumn("timestamp", F.expr(SIM_TS))

    def table(column):
        return timed.select("node", "timestamp", F.col(column).alias("reading"))

    x = table("lat")
    y = timed.where("color <> 'white'").select("node", "timestamp", F.col("lon").alias("reading"))
    speed = timed.where("mph >= 5").select("node", "timestamp", F.col("mph").alias("reading"))
    return x, y, speed


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single readings: speed twice, two unrelated types, and no longitude for very fast vehicles."""
    return status(spark, sf_dir).selectExpr("node", "ts", """inline(array_compact(array(
        named_struct('type', 'mph', 'reading', mph + 1.0D, 'seq', 1),
        named_struct('type', 'lat', 'reading', lat, 'seq', 2),
        named_struct('type', 'mph', 'reading', mph, 'seq', 3),
        CASE WHEN mph <= 200 THEN named_struct('type', 'lon', 'reading', lon, 'seq', 4) END,
        named_struct('type', 'temperature', 'reading', temperature, 'seq', 5),
        named_struct('type', 'noise', 'reading', 99.0D, 'seq', 6),
        named_struct('type', 'count', 'reading', 1.0D, 'seq', 7))))""")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster heads: each white row names the head its node has from then on."""
    return status(spark, sf_dir).where("color = 'white'").selectExpr("node", "ts", "event_id % 8 AS head")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed messages with tags; freezing ones are probes and very fast ones carry two tags."""
    return status(spark, sf_dir).selectExpr(
        "event_id", "node AS key", "mph AS value",
        "CASE event_id % 3 WHEN 0 THEN 'q0' WHEN 1 THEN 'q1' END AS key_uid",
        "CASE WHEN mph > 200 THEN 'q0' ELSE CASE event_id % 3 WHEN 0 THEN 'q0' WHEN 1 THEN 'q1' END END AS value_uid",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS created_ms", "temperature = 0 AS is_canary")


def gossip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines (path, position, line) of every node and day.

    Some nodes are out on two days of three; some lines follow an earlier one for the same day.
    """
    means = status(spark, sf_dir).groupBy("node").agg(
        F.expr("sum(CAST(rint(mph * 10000) AS BIGINT)) div count(*)").alias("mean_units"))
    total = means.agg(F.count("*")).scalar()
    days = means.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1)))).withColumn("total", total)
    kept = days.where("(node + d) % 13 <> 0 OR d % 3 = 0").withColumn(
        "units", F.expr("mean_units + 200000 div (1 + d)"))
    lines = kept.withColumn("position", F.explode(F.when(
        F.expr("(node + d) % 5 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    return lines.withColumn("shown", F.expr("CASE WHEN position = 0 THEN units + 10000 ELSE units END")).selectExpr(
        "concat('LogOutput/', CASE WHEN node < 8 THEN 'CLUSTERHEAD-' ELSE 'node-' END, node, '/output.log') AS path",
        "position",
        f"""concat('FINAL RESULT: {{[op=avg, item=ids]=', {units_text('shown', 4)},
            CASE WHEN (node + d) % 5 = 0 THEN '' ELSE concat(', [op=sum, item=ids]=', total, '.0') END,
            '}} EPOCH: ', date_format(date_add(DATE'2024-01-01', d), 'yyyy-MM-dd'), 'T00:00:00Z') AS line""")


def uuid_of(text: str) -> str:
    """SQL for an id in 8-4-4-4-12 form made from a text."""
    h = f"md5({text})"
    parts = [f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return "concat(" + ", '-', ".join(parts) + ")"


LEAD = uuid_of("CAST(event_id AS STRING)")
FOLLOW = uuid_of("concat('f', event_id)")


#: Messages that commit where the fastest never do.
SLOW_COMMITS = "mph <= 180"


def message_lines(spark: SparkSession, sf_dir: str, commits: str = "true") -> DataFrame:
    """Log lines of every event: fast messages get lost, slow ones are not queued, pairs commit twice. ``commits`` says which commit at all."""
    return status(spark, sf_dir).selectExpr(
        "mph", "color", "ts", f"{LEAD} AS lead", f"{FOLLOW} AS follow",
    ).selectExpr(f"""explode(array_compact(array(
        concat('DEBUG OutSocketManager trying to send ', lead),
        CASE WHEN mph <= 150 THEN concat('DEBUG NetworkLayer message 1 from: 2 got ', lead) END,
        CASE WHEN mph BETWEEN 2 AND 150 THEN concat('DEBUG from 2 queueing ', lead) END,
        CASE WHEN {commits} THEN concat('DEBUG Consensus commit ', lead, ' ', follow) END,
        CASE WHEN mph <= 100 THEN concat('DEBUG Consensus commit ', lead, ' ', follow) END,
        CASE WHEN color = 'white' THEN concat('DEBUG Consensus abort ', lead) END,
        CASE WHEN mph > 300 THEN 'DEBUG Consensus abort null' END,
        CASE WHEN color = 'red' THEN 'ERROR: unexpected message' END,
        CASE WHEN color = 'green' THEN concat('DEBUG trying to start new round on epoch ',
            date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")) END,
        'DEBUG idle'))) AS line""")


def sends(state: DataFrame) -> DataFrame:
    """Who sends to whom in each round: ring hops that double, some of them failing."""
    size = F.lit(state.agg(F.max("node") + 1).first()[0])
    return state.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")
                        ).withColumn("n", size).selectExpr(
        "round", "src", "(src + shiftleft(1L, round)) % n AS dst", "(src * 31 + round) % 11 <> 0 AS ok")


def pairs(state: DataFrame) -> DataFrame:
    """Who meets whom in each round: ids that differ in one bit, some meetings failing."""
    size = F.lit(state.agg(F.max("node") + 1).first()[0])
    return state.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")
                        ).withColumn("n", size).selectExpr(
        "round", "a", "a ^ shiftleft(1L, round) AS b", "n", "(a * 31 + round) % 11 <> 0 AS ok"
    ).where("a < b AND b < n").drop("n")


# The same tables for the SQL checks.
TWINS = {
    "status": f"""SELECT event_id, ts, user_id AS node,
        CAST(40000 + (event_id * 7919) % 20000 AS DOUBLE) AS lat,
        CAST(100000 + (event_id * 104729) % 14000 AS DOUBLE) AS lon,
        value AS mph, {COLOUR} AS color,
        CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS temperature,
        CAST(20 + event_id % 60 AS DOUBLE) AS humidity,
        CAST(event_id % 10 AS DOUBLE) AS tireDistance, CAST(12 + event_id % 5 AS DOUBLE) AS groundDistance,
        CAST(event_id % 7 - 3 AS DOUBLE) AS ax, CAST(event_id % 5 - 2 AS DOUBLE) AS ay,
        CAST(event_id % 3 - 1 AS DOUBLE) AS az,
        CAST(epoch_us(ts) // 1000000 AS DOUBLE) + (event_id % 4) * 0.25 AS sim_ts,
        CAST(ROUND(value * 10000) AS BIGINT) AS units
        FROM events""",
    "posx": "SELECT node, sim_ts AS timestamp, lat AS reading FROM status",
    "posy": "SELECT node, sim_ts AS timestamp, lon AS reading FROM status WHERE color <> 'white'",
    "speed": "SELECT node, sim_ts AS timestamp, mph AS reading FROM status WHERE mph >= 5",
    "positions": """SELECT x.node, x.timestamp, x.reading AS x, y.reading AS y, s.reading AS speed
        FROM posx x JOIN posy y ON x.node = y.node AND x.timestamp = y.timestamp
        JOIN speed s ON x.node = s.node AND x.timestamp = s.timestamp""",
    "membership": "SELECT node, ts, event_id % 8 AS head FROM status WHERE color = 'white'",
    "headed": """SELECT s.*, COALESCE(m.head, s.node) AS head
        FROM status s ASOF LEFT JOIN membership m ON s.node = m.node AND s.ts >= m.ts""",
    "log": f"""SELECT node, d, CASE WHEN node < 8 THEN 'CLUSTERHEAD' ELSE 'node' END AS kind,
        strftime(DATE '2024-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS epoch,
        CAST(mean_units + 200000 // (1 + d) AS DOUBLE) / 10000.0 AS value,
        CASE WHEN (node + d) % 5 <> 0 THEN CAST(total AS DOUBLE) END AS total
        FROM (SELECT node, CAST(SUM(units) AS BIGINT) // COUNT(*) AS mean_units, COUNT(*) OVER () AS total
              FROM status GROUP BY node) m, range({DAYS}) r(d)
        WHERE (node + d) % 13 <> 0 OR d % 3 = 0""",
    "ids": f"""SELECT *, {uuid_of('CAST(event_id AS VARCHAR)')} AS lead,
        {uuid_of("concat('f', event_id)")} AS follow FROM status""",
}
_NEEDS = {
    "posx": ["status"], "posy": ["status"], "speed": ["status"],
    "positions": ["posx", "posy", "speed"], "membership": ["status"],
    "headed": ["status", "membership"], "log": ["status"], "ids": ["status"],
}
TOTAL = "CAST(SUM(units) AS DOUBLE) / 10000.0"
AVERAGE = f"{TOTAL} AS total, COUNT(*) AS n, {TOTAL} / COUNT(*) AS mean"


def check(body: str, *tables: str, more: str = "") -> str:
    """A SQL check: the named twin tables in front of its body."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in tables or ("status",):
        add(name)
    ctes = [f"{name} AS ({TWINS[name]})" for name in wanted]
    return "WITH " + ", ".join(ctes + ([more] if more else [])) + " " + body
