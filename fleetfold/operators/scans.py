"""Order-dependent operators that never put all rows of a key into one task.

Each works in two levels. Rows are split by (key, time bucket); one small
summary row per bucket is scanned in key order, and its outcome enters every
bucket as a carried row. A key that holds a third of the table is thereby
spread over as many tasks as it has buckets. ``bucket`` is a ``date_trunc``
unit, or a width for times that are numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BROADCAST_ROWS = 100_000
BROADCAST_PER_KEY = 512


def bucket_for(df: DataFrame, time: str, bucket: str | float | None) -> str | float:
    """The bucket to use for a time column: an hour, as a unit or in seconds, unless one is given that fits its type."""
    number = isinstance(df.schema[time].dataType, NumericType)
    if bucket is None:
        return 3600.0 if number else "hour"
    if number == isinstance(bucket, str):
        raise ValueError(f"bucket {bucket!r} does not fit the type of {time!r}")
    return bucket


def bucket_of(bucket: str | float, time: str) -> Column:
    return F.date_trunc(bucket, time) if isinstance(bucket, str) else F.floor(F.col(time) / F.lit(bucket))


def running_total(df: DataFrame, keys: Sequence[str], time: str, value: Column | str,
                  name: str, ties: Sequence[str] = (), bucket: str | float | None = None) -> DataFrame:
    """Cumulative sum of ``value`` per key in (time, ties) order."""
    amount = F.col(value) if isinstance(value, str) else value
    bucket = bucket_for(df, time, bucket)
    rows = df.withColumn("_bucket", bucket_of(bucket, time)).withColumn("_amount", amount)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_bucket", F.sum("_sum").over(earlier).alias("_amount"),
                          F.lit(0).alias("_kind"))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_kind", time, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (both.withColumn(name, F.sum("_amount").over(so_far))
            .where(F.col("_kind") == 1).select(*df.columns, name))


def row_position(df: DataFrame, keys: Sequence[str], time: str, name: str,
                 ties: Sequence[str] = (), bucket: str | float | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, time, F.lit(1), name, ties, bucket)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts to n per task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
          value: str, strategy: str = "auto", bucket: str | float | None = None) -> DataFrame:
    """Adds the right value with the greatest time not after the left row's time.

    Null where there is no earlier right row. ``auto`` counts the right side
    first: when it is small overall and per key its validity intervals are
    broadcast and the left side is not shuffled at all; otherwise the two-level
    scan is used. At equal times of one key the greatest value holds.
    """
    bucket = bucket_for(left, left_time, bucket)
    changes = right.select(F.col(key), F.col(right_time).alias("_from"), F.col(value).alias("_new"))
    changes = changes.where(F.col(key).isNotNull() & F.col("_from").isNotNull())
    changes = changes.groupBy(key, "_from").agg(F.max("_new").alias("_new"))
    if strategy == "auto":
        size = changes.groupBy(key).count().agg(
            F.sum("count").alias("rows"), F.max("count").alias("widest")).first()
        small = (size["rows"] or 0) <= BROADCAST_ROWS and (size["widest"] or 0) <= BROADCAST_PER_KEY
        strategy = "broadcast" if small else "scan"
    if strategy == "broadcast":
        return _as_of_intervals(left, changes, key, left_time, value)
    if strategy == "scan":
        return _as_of_scan(left, changes, key, left_time, value, bucket)
    raise ValueError(f"unknown as-of strategy {strategy!r}")


def _as_of_intervals(left, changes, key, left_time, value):
    in_order = Window.partitionBy(key).orderBy("_from")
    spans = changes.select(
        F.col(key).alias("_key"), "_from", F.lead("_from").over(in_order).alias("_to"),
        F.col("_new").alias(value))
    at = F.col(left_time)
    match = ((F.col(key) == F.col("_key")) & (at >= F.col("_from"))
             & (F.col("_to").isNull() | (at < F.col("_to"))))
    return left.join(F.broadcast(spans), match, "left").drop("_key", "_from", "_to")


def _as_of_scan(left, changes, key, left_time, value, bucket):
    rows = left.withColumn("_at", F.col(left_time)).withColumn("_kind", F.lit(2))
    news = changes.withColumnRenamed("_from", "_at").withColumn("_kind", F.lit(1)).withColumn("_has", F.lit(True))
    rows, news = (d.withColumn("_bucket", bucket_of(bucket, "_at")) for d in (rows, news))
    # Inside a struct a change to null counts as a change.
    change = F.when(F.col("_has"), F.struct("_new"))
    in_bucket = news.groupBy(key, "_bucket").agg(F.max_by("_new", "_at").alias("_new"), F.max("_has").alias("_has"))
    spine = (
        rows.select(key, "_bucket").distinct().unionByName(in_bucket, allowMissingColumns=True)
        .groupBy(key, "_bucket").agg(F.max("_new").alias("_new"), F.max("_has").alias("_has"))
    )
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spine.select(key, "_bucket", F.last(change, ignorenulls=True).over(earlier).alias("_held")).select(
        key, "_bucket", F.col("_held._new").alias("_new"), F.col("_held").isNotNull().alias("_has"),
        F.lit(0).alias("_kind"))
    both = (rows.unionByName(news, allowMissingColumns=True)
            .unionByName(carried, allowMissingColumns=True))
    so_far = Window.partitionBy(key, "_bucket").orderBy(
        F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_held", F.last(change, ignorenulls=True).over(so_far))
    return held.where(F.col("_kind") == 2).select(
        *left.columns, F.col("_held._new").alias(value))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Equal values of a group as one row with their number ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def exact_median(counts: DataFrame, keys: Sequence[str], value: str, name: str,
                 bins: int = 1024) -> DataFrame:
    """Exact median per group, from ``value_counts``, never holding a group in one task.

    Equal values already collapsed to one counted row before the shuffle. Bin
    counts tell which bin holds the middle ranks, and only that bin is ranked.
    Keys must not be null.
    """
    keys = list(keys)
    counts = counts.where(F.col(value).isNotNull()).select(*keys, value, "n")
    spread = counts.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("_total"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    binned = counts.join(spread, keys).withColumn(
        "_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    lower, upper = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    middle = (
        binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_size"), F.max("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .where((F.col("_before") < upper) & (F.col("_before") + F.col("_size") >= lower))
        .select(*keys, "_bin", "_before")
    )
    so_far = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = binned.join(middle, [*keys, "_bin"]).withColumn(
        "_upto", F.col("_before") + F.sum("n").over(so_far))

    def at(rank):
        hit = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)
        return F.max(F.when(hit, F.col(value)))

    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2.0).alias(name))


def ordered_fold(df: DataFrame, keys: Sequence[str], time: str, text: str,
                 ties: Sequence[str] = (), piece: int = 1000, bucket: str | float | None = None,
                 name: str = "text") -> DataFrame:
    """Concatenation of texts in (time, ties) order, in pieces of bounded size.

    Piece p of a key holds its texts p*piece .. (p+1)*piece - 1, so joining the
    pieces in order gives the whole fold, however long it is.
    """
    placed = row_position(df, keys, time, "_pos", ties, bucket)
    placed = placed.withColumn("piece", F.expr(f"(_pos - 1) div {int(piece)}"))
    texts = F.sort_array(F.collect_list(F.struct("_pos", F.col(text).alias("_text"))))
    return placed.groupBy(*keys, "piece").agg(
        F.array_join(F.transform(texts, lambda t: t["_text"]), "").alias(name))


def exact_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left rows with their right row at exactly the same keys, and left rows without one.

    The join is left to adaptive execution, which measures the right side before
    it chooses to broadcast it and splits hot keys of the left side otherwise.
    """
    return left.join(right, list(keys)), left.join(right, list(keys), "left_anti").select(*left.columns)
