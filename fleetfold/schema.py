"""Row types shared by sources, operators and sinks."""

from pyspark.sql import types as T

# The colour domain of a status row.
COLOURS = ("red", "orange", "yellow", "green", "blue", "purple", "gray", "white", "black")

ACCELERATION = T.StructType([T.StructField(axis, T.DoubleType()) for axis in ("x", "y", "z")])

# The keys of the textual status form and the type each one carries.
STATUS_KEYS = {
    "id": "bigint",
    "lat": "double",
    "lon": "double",
    "mph": "double",
    "color": "string",
    "temperature": "double",
    "humidity": "double",
    "tireDistance": "double",
    "groundDistance": "double",
    "acceleration": "struct<x:double,y:double,z:double>",
}

STATUS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("mph", T.DoubleType()),
        T.StructField("color", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("tireDistance", T.DoubleType()),
        T.StructField("groundDistance", T.DoubleType()),
        T.StructField("acceleration", ACCELERATION),
    ]
)

READING = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("reading", T.DoubleType()),
    ]
)

MEMBERSHIP = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("clusterhead", T.LongType()),
    ]
)

REGION = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("rid", T.StringType()),
        T.StructField("lat_min", T.DoubleType()),
        T.StructField("lat_max", T.DoubleType()),
        T.StructField("lon_min", T.DoubleType()),
        T.StructField("lon_max", T.DoubleType()),
    ]
)
