"""Writing streams: files, several sinks at once, Kafka, and keyed result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetfold.sources.readers import CSV_OPTIONS


def trigger(writer, every: str | None):
    """Micro-batches at a steady pace, or all available data and then stop."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def relay(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Records passed on unchanged, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def append_rows(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows as they become final, for instance windows once their watermark has passed."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint)
    return trigger(writer, every).start()


def fan_out(stream: DataFrame, outs: Sequence[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Every record to every sink.

    A batch goes to a folder named by its id and replaces that folder, so a
    batch that is run again after a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for out in outs:
                batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    return trigger(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), every).start()


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return trigger(writer.foreachBatch(action), every).start()


def print_rows(stream: DataFrame, every: str | None = None) -> StreamingQuery:
    return trigger(stream.writeStream.outputMode("append").format("console"), every).start()


def upsert_results(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Changed results of each batch, to be read back with ``latest_results``.

    Only rows that changed are written, however large the state is. A stream without input leaves an empty table.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return each_batch(stream, write, checkpoint, every)


def latest_results(spark: SparkSession, out: str, keys: Sequence[str], merged: str | None = None) -> DataFrame:
    """The newest version of every result written by ``upsert_results``.

    With ``merged``, a folder that ``merge_results`` keeps, only that and the batches since then are read.
    """
    return _newest(_versions(spark, out, merged), keys)


def merge_results(spark: SparkSession, out: str, keys: Sequence[str], merged: str) -> int | None:
    """Merges the versions of all batches but the last into one table, while the stream may go on; gives the last batch merged.

    The last batch may still be written or run again, so it stays apart. A merge counts once its line is in the log beside
    the folder; one that failed before is run again over the same batches. Merged batches are not read any more and may be removed.
    """
    done, last = _merged_to(spark, merged), spark.read.parquet(out).agg(F.max("batch")).first()[0]
    if last is None or last - 1 <= (-1 if done is None else done):
        return done
    old = _versions(spark, out, merged).where(F.col("batch") < last)
    _newest(old, keys).write.mode("overwrite").parquet(f"{merged}/to={last - 1}")
    spark.createDataFrame([(last - 1,)], "to int").coalesce(1).write.mode("append").parquet(f"{merged}-log")
    return last - 1


def _newest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def _merged_to(spark: SparkSession, merged: str) -> int | None:
    try:
        return spark.read.parquet(f"{merged}-log").agg(F.max("to")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _versions(spark: SparkSession, out: str, merged: str | None) -> DataFrame:
    versions = spark.read.parquet(out)
    done = None if merged is None else _merged_to(spark, merged)
    if done is None:
        return versions
    before = spark.read.parquet(f"{merged}/to={done}").withColumn("batch", F.lit(done))
    return versions.where(F.col("batch") > done).unionByName(before)


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    """Enveloped messages to one topic, acknowledged by all replicas; needs the Kafka connector."""
    writer = (messages.select(F.col("key").cast("binary"), F.col("value").cast("binary")).writeStream
              .format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
              .option("kafka.acks", "all")
              .option("checkpointLocation", checkpoint))
    return trigger(writer, every).start()


def write_csv(df: DataFrame, out: str) -> None:
    """A byte log or another report as CSV with a header."""
    df.write.mode("errorifexists").options(**CSV_OPTIONS).csv(out)


def append_csv(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream's final rows as CSV with a header and times to the microsecond; read back with ``readers.csv_rows``."""
    writer = stream.writeStream.outputMode("append").format("csv").options(**CSV_OPTIONS).option("path", out)
    return trigger(writer.option("checkpointLocation", checkpoint), every).start()


def save_results(df: DataFrame, out: str, run: str) -> None:
    """Epoch results as JSON lines, kept apart by run; a run saved again replaces itself."""
    writer = df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run").json(out)
