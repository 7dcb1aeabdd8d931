"""Where status rows, readings, messages and log lines come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetfold.operators.messages import concat_sources, unwrap
from fleetfold.schema import STATUS

#: How reports are written and read as CSV: times keep their microseconds.
CSV_OPTIONS = {
    "header": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows that ``sinks.append_csv`` or ``sinks.write_csv`` wrote; a row that does not fit the schema is an error."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, mode="FAILFAST", enforceSchema="false").csv(path)


def status_files(spark: SparkSession, path: str, schema: StructType = STATUS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def file_stream(spark: SparkSession, path: str, schema: StructType = STATUS,
                name_pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A growing directory of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def kafka_options(servers: str, topics: Sequence[str], starting: str = "latest") -> dict[str, str]:
    """Options of a Kafka read; records start at ``latest`` unless told otherwise."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str],
                 starting: str = "latest") -> DataFrame:
    """Raw key and value bytes of some topics; needs the Kafka connector package."""
    options = kafka_options(servers, topics, starting)
    return spark.readStream.format("kafka").options(**options).load().select("topic", "key", "value", "timestamp")


def topics_by_broker(topics: Sequence[tuple[str, str]]) -> dict[str, list[str]]:
    """(servers, topic) pairs as the topics to read from each set of servers."""
    grouped: dict[str, set[str]] = {}
    for servers, topic in topics:
        grouped.setdefault(servers, set()).add(topic)
    return {servers: sorted(names) for servers, names in grouped.items()}


def kafka_clusters(spark: SparkSession, clusters: Mapping[str, Sequence[str]],
                   starting: str = "latest") -> DataFrame:
    """Topics of several Kafka clusters as one stream, marked with the cluster."""
    return concat_sources(
        {servers: kafka_stream(spark, servers, topics, starting) for servers, topics in clusters.items()},
        label="cluster")


def typed_messages(raw: DataFrame, key_type: str, value_type: str) -> DataFrame:
    """Enveloped JSON messages as typed columns, see ``operators.messages.unwrap``."""
    return unwrap(raw, key_type, value_type)


def jdbc_options(url: str, table: str, low: int, high: int, partitions: int,
                 column: str = "node", fetch: int = 10_000) -> dict[str, str]:
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch),
    }


def jdbc_readings(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int) -> DataFrame:
    """A reading or membership table, read in parallel by node range.

    One partitioned scan stands for a query per node; the bounds only set the
    stride, rows outside them are read too.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, table, low, high, partitions)).load()


def node_logs(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all log files under ``root`` as (path, node, position, line).

    The node is the directory name. ``position`` orders the lines of a file:
    by the start of the split they were read from, then as read.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    path = F.col("_metadata.file_path")
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.select(path.alias("path"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("node"),
                        place.alias("position"), F.col("value").alias("line"))


def message_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def demo_rate(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A steady stream of (timestamp, value) for demonstrations."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
