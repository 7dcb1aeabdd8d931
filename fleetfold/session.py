"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
SHUFFLE_BYTES = 128 * 1024 * 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore.rocksdb"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on; cluster sizing stays with the caller.

    Streaming state goes to RocksDB, so it is not bounded by the heap. A batch writes its changes only, rows of state are
    not counted, and a join keeps one store per partition instead of four.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(f"{STATE}.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{STATE}.trackTotalNumberOfRows", "false")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    return spark


def size_shuffles(spark: SparkSession, shuffled_bytes: int, target: int = SHUFFLE_BYTES) -> int:
    """Sets enough shuffle partitions for each to hold about ``target`` bytes.

    Adaptive execution merges the ones that turn out small. Streams keep the
    number their checkpoint began with.
    """
    cores = spark.sparkContext.defaultParallelism
    partitions = max(cores, -(-shuffled_bytes // target))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh temporary
    folder; on a cluster a machine-local folder would lose data with its host.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if context.master.startswith("local"):
        return tempfile.mkdtemp(prefix="fleetfold-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The frame is computed once, the copy survives lost executors, and the plan
    that follows starts from a plain scan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it ends, not when the driver happens to collect its garbage.

    It holds for frames that are made inside. One that is used again after that is computed anew, so what is
    returned to a caller has to be made outside.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of a control table, or None when it holds more than ``limit``."""
    rows = df.take(limit + 1)
    return None if len(rows) > limit else rows


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side is small.

    A larger side is returned unhinted, so the join shuffles and adaptive
    execution splits its hot keys.
    """
    fits = small_rows(df.select(F.lit(1)), limit) is not None
    return F.broadcast(df) if fits else df
