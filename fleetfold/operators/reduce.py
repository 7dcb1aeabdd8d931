"""Reductions by key: declared ones by name, opaque ones by a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold.functions.scalars import fixed_sum

REDUCTIONS = ("sum", "min", "max", "average", "union", "first")
FLUSH_KEYS = 50_000
FAN_IN = 64


def aggregates(op: str, value: str = "value", order: Sequence[str] = (),
               digits: int | None = None) -> list[Column]:
    """Aggregate columns of a reduction.

    ``average`` keeps the (sum, count) pair so results can be reduced again.
    ``digits`` makes sums exact to that many decimals, see ``fixed_sum``.
    ``first`` needs order columns, because rows have no order of their own.
    """
    total = F.sum(value) if digits is None else fixed_sum(value, digits)
    if op == "sum":
        return [total.alias(value)]
    if op == "min":
        return [F.min(value).alias(value)]
    if op == "max":
        return [F.max(value).alias(value)]
    if op == "average":
        return [total.alias("total"), F.count(value).alias("n"),
                F.try_divide(total, F.count(value)).alias("mean")]
    if op == "union":
        return [F.sort_array(F.collect_set(value)).alias(value)]
    if op == "first":
        if not order:
            raise ValueError("a first-wins reduction needs order columns")
        return [F.min_by(value, F.struct(*order)).alias(value)]
    raise ValueError(f"unknown reduction {op!r}")


def reduce_by_key(df: DataFrame, keys: Sequence[Column | str], op: str, value: str = "value",
                  order: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """One row per key. A null key is a key like any other."""
    return df.groupBy(*keys).agg(*aggregates(op, value, order, digits))


def merge_averages(df: DataFrame, keys: Sequence[Column | str], digits: int | None = None) -> DataFrame:
    """Second level of an average: adds up (total, n) pairs."""
    total = F.sum("total") if digits is None else fixed_sum("total", digits)
    return df.groupBy(*keys).agg(
        total.alias("total"),
        F.sum("n").alias("n"),
        F.try_divide(total, F.sum("n")).alias("mean"),
    )


def merges(op: str, value: str = "value", digits: int | None = None) -> list[Column]:
    """Aggregate columns that reduce the results of ``aggregates`` once more, for reductions that allow it."""
    if op == "average":
        total = F.sum("total") if digits is None else fixed_sum("total", digits)
        return [total.alias("total"), F.sum("n").alias("n"), F.try_divide(total, F.sum("n")).alias("mean")]
    if op == "union":
        return [F.sort_array(F.array_distinct(F.flatten(F.collect_list(value)))).alias(value)]
    if op in ("sum", "min", "max"):
        return aggregates(op, value, digits=digits)
    raise ValueError(f"results of {op!r} cannot be reduced again")


def full_reduce(df: DataFrame, op: str, value: str = "value",
                digits: int | None = None) -> DataFrame:
    """Reduction over all rows; tasks send one partial row each."""
    return df.agg(*aggregates(op, value, digits=digits))


def custom_reduce(df: DataFrame, key: str | Sequence[str], value: str, fold: Callable, fan_in: int = FAN_IN) -> DataFrame:
    """Reduction by an opaque associative and commutative Python function, by one key column or several.

    Each task folds its own rows and passes on one value per key. Those partial
    values are folded in ``fan_in`` slots per key and then once more. The later
    steps read their partials sorted by key, so a task holds one running value
    at a time and never the rows of a key, however many there are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    plain = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (*keys, value)])
    slotted = T.StructType([*plain, T.StructField("slot", T.IntegerType())])

    partials = df.select(*keys, value).mapInArrow(_fold_tasks(fold, plain, fan_in), slotted)
    slots = partials.repartition(*keys, "slot").sortWithinPartitions(*keys, "slot").select(*keys, value)
    merged = slots.mapInArrow(_fold_runs(fold, plain), plain)
    whole = merged.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return whole.mapInArrow(_fold_runs(fold, plain), plain)


def custom_reduce_windowed(df: DataFrame, key: str | Sequence[str], value: str, fold: Callable, window: str,
                           time: str = "ts", fan_in: int = FAN_IN) -> DataFrame:
    """``custom_reduce`` in tumbling event-time windows of a batch frame; ``streaming.folds`` has the form for streams.

    Rows without a time are in no window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    span = F.window(F.col(time).cast("timestamp"), window)
    rows = df.where(F.col(time).isNotNull()).select(
        F.unix_micros(span.start).alias("window_start"), F.unix_micros(span.end).alias("window_end"), *keys, value)
    folded = custom_reduce(rows, ["window_start", "window_end", *keys], value, fold, fan_in)
    return folded.withColumns({c: F.timestamp_micros(c) for c in ("window_start", "window_end")})


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pairs(batches: Iterator, keys: int) -> Iterator:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(keys + 1)]
        yield from zip(zip(*columns[:keys]), columns[keys])


def _columns(names: Sequence[str], keys: Sequence[tuple], values: Sequence) -> dict:
    return dict(zip(names, [*map(list, zip(*keys)), list(values)]))


def _fold_tasks(fold: Callable, plain: T.StructType, fan_in: int) -> Callable:
    """One partial value per key of a task, labelled with the slot the task feeds."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() % fan_in
        schema = _arrow(plain).append(pa.field("slot", pa.int32()))
        folded: dict = {}

        def flush():
            columns = _columns(plain.names, folded, folded.values()) | {"slot": [slot] * len(folded)}
            folded.clear()
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        for k, v in _pairs(batches, len(plain) - 1):
            folded[k] = fold(folded[k], v) if k in folded else v
            if len(folded) >= FLUSH_KEYS:
                yield flush()
        if folded:
            yield flush()

    return run


def _fold_runs(fold: Callable, plain: T.StructType) -> Callable:
    """Folds neighbouring rows of equal key into one."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = _arrow(plain)
        keys: list = []
        values: list = []
        for k, v in _pairs(batches, len(plain) - 1):
            if keys and keys[-1] == k:
                values[-1] = fold(values[-1], v)
                continue
            if len(keys) >= FLUSH_KEYS:
                yield pa.RecordBatch.from_pydict(_columns(plain.names, keys, values), schema=schema)
                keys, values = [], []
            keys.append(k)
            values.append(v)
        if keys:
            yield pa.RecordBatch.from_pydict(_columns(plain.names, keys, values), schema=schema)

    return run


def set_union(df: DataFrame, keys: Sequence[Column | str], value: str) -> DataFrame:
    """Distinct values of a small domain per key, as a sorted array."""
    return reduce_by_key(df, keys, "union", value)


def set_chunks(df: DataFrame, keys: Sequence[str], value: str, chunk: int = 10_000) -> DataFrame:
    """Distinct values of any domain per key, as rows (keys, ``part``, ``value``) of sorted arrays of up to ``chunk`` values.

    ``set_union`` for sets that no row should hold whole. Values are made distinct with partial results, spread by hash
    over as many lists as the fullest key needs, and each list is cut. Nulls are left out.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    fullest = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lists = max(1, -(-fullest // chunk))
    spread = distinct.withColumn("_list", F.pmod(F.xxhash64(value), F.lit(lists)))
    place = F.row_number().over(Window.partitionBy(*keys, "_list").orderBy(value))
    cut = spread.withColumn("_cut", F.floor((place - 1) / F.lit(chunk)))
    parts = cut.groupBy(*keys, "_list", "_cut").agg(F.sort_array(F.collect_list(value)).alias(value))
    return parts.select(*keys, (F.col("_cut") * F.lit(lists) + F.col("_list")).alias("part"), value)


def latest_row(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The whole most recent row, overall or per key."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return picked.where(F.col("row").isNotNull()).select("row.*")


def earliest_row(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The whole first row, overall or per key."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return picked.where(F.col("row").isNotNull()).select("row.*")


def set_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries that appeared or vanished between two snapshots.

    One aggregation over the tagged union: both directions from one shuffle,
    with duplicates collapsed before it.
    """
    tagged = before.select(*keys, F.lit(1).alias("was"), F.lit(0).alias("now")).unionByName(
        after.select(*keys, F.lit(0).alias("was"), F.lit(1).alias("now"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    return sides.where(F.col("was") != F.col("now")).select(
        *keys, F.when(F.col("now") == 1, "started").otherwise("stopped").alias("change")
    )
