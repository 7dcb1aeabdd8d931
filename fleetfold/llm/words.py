"""Word rules and small helpers shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfold.session import cut_lineage, scratch_path

__all__ = ["ascii_lower", "ascii_words", "broadcast_below", "cut_lineage", "fresh_name", "partitions", "scratch_path", "small_batches"]

#: Runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1))


def small_batches(spark: SparkSession, rows: int = 500) -> SparkSession:
    """Sends texts to Python in batches that stay small even where all of them are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast after counting that the frame has at most ``rows`` rows.

    Beyond that the frame stays as it is and the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
