"""A query: one filter, one map to (key, value) and one reduction by key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

from fleetfold.functions.scalars import fixed_sum
from fleetfold.operators.reduce import REDUCTIONS, aggregates, full_reduce


@dataclass(frozen=True)
class MapReduceQuery:
    """Declared with SQL expressions, so it can be stored, compared and optimised.

    The same declaration runs on a batch or a streaming frame. Two queries with
    the same text are the same query.
    """

    id: str
    key: str
    value: str
    reduce: str | None = None
    where: str | None = None
    order: tuple[str, ...] = ()
    digits: int | None = None

    def __post_init__(self) -> None:
        if self.reduce is not None and self.reduce not in REDUCTIONS:
            raise ValueError(f"unknown reduction {self.reduce!r}")
        if self.reduce == "first" and not self.order:
            raise ValueError("a first-wins reduction needs order columns")

    def mapped(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Filter, then map; ``keep`` passes columns on beside key and value."""
        rows = df.where(self.where) if self.where else df
        extra = [*keep, *[c for c in self.order if c not in keep]]
        return rows.select(*extra, F.expr(self.key).alias("key"), F.expr(self.value).alias("value"))

    def aggregates(self) -> list[Column]:
        if self.reduce is None:
            raise ValueError(f"query {self.id!r} has no reduction")
        return aggregates(self.reduce, order=self.order, digits=self.digits)

    def run(self, df: DataFrame) -> DataFrame:
        """All rows reduced by key."""
        return self.mapped(df).groupBy("key").agg(*self.aggregates())

    def run_windowed(self, df: DataFrame, window: str, time: str = "ts",
                     by: Sequence[str] = ()) -> DataFrame:
        """Rows reduced by key in tumbling event-time windows.

        On a streaming frame give it a watermark first.
        """
        span = F.window(time, window)
        reduced = self.mapped(df, [time, *by]).groupBy(span, *by, "key").agg(*self.aggregates())
        return reduced.select(F.col("window.start").alias("window_start"),
                              F.col("window.end").alias("window_end"),
                              *[c for c in reduced.columns if c != "window"])

    def run_all(self, df: DataFrame) -> DataFrame:
        """All values reduced to one, whatever their key."""
        return full_reduce(self.mapped(df), self.reduce or "sum", digits=self.digits)


def run_tagged(queries: Sequence[MapReduceQuery], df: DataFrame, window: str,
               time: str = "ts") -> DataFrame:
    """Several queries with one reduction and value type over one scan of a stream.

    Each row is mapped once per query that wants it, tagged with the query id,
    and all are reduced by (query, window, key) in one shuffle.
    """
    kinds = {(q.reduce, q.digits, q.order) for q in queries}
    if len(kinds) != 1:
        raise ValueError("queries sharing a stream must share a reduction; run_mixed takes different ones")
    if len({q.id for q in queries}) != len(queries):
        raise ValueError("query ids must be unique")
    first = queries[0]
    records = [
        F.when(F.expr(q.where) if q.where else F.lit(True), F.struct(
            F.lit(q.id).alias("query_uid"), F.expr(q.key).cast("string").alias("key"),
            F.expr(q.value).alias("value")))
        for q in queries
    ]
    tagged = df.select(time, *first.order, F.inline(F.array_compact(F.array(*records))))
    reduced = tagged.groupBy(F.window(time, window), "query_uid", "key").agg(*first.aggregates())
    return reduced.select("query_uid", F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"),
                          *[c for c in reduced.columns if c not in ("window", "query_uid")])


#: Reductions that a stream of tagged records can be put through beside each other.
MIXED = ("sum", "average", "min", "max", "union", "first")


def run_mixed(queries: Sequence[MapReduceQuery], df: DataFrame, window: str, time: str = "ts") -> DataFrame:
    """Several queries with reductions and value types of their own over one scan, in one shuffle.

    Each row is mapped once per query that wants it; a record carries the query's id and reduction, and its value as a
    ``number`` or, where it is no number, as ``text`` (structs as JSON). All records are reduced by (query, window, key) with
    one accumulator per kind of reduction that occurs, each fed by the records tagged with it. Results, null where a
    query's reduction has none: ``number`` (sum, mean, least, greatest or first), ``n`` (values that are not null), ``text``
    (least, greatest or first), ``members`` (a union, sorted, as text).

    Sums are exact to ``digits`` where all sums and averages name the same. First-wins queries share their order columns.
    Works on a batch frame, or on a stream with a watermark.
    """
    if len({q.id for q in queries}) != len(queries):
        raise ValueError("query ids must be unique")
    if any(q.reduce not in MIXED for q in queries):
        raise ValueError("every query needs a reduction")
    orders = {q.order for q in queries if q.reduce == "first"}
    if len(orders) > 1:
        raise ValueError("first-wins queries must share their order columns")
    order = next(iter(orders), ())
    digits = {q.digits for q in queries if q.reduce in ("sum", "average")}
    total = fixed_sum("_added", digits.pop()) if len(digits) == 1 and None not in digits else F.sum("_added")

    def record(q: MapReduceQuery) -> Column:
        value, kind = F.expr(q.value), df.select(F.expr(q.value)).schema[0].dataType
        is_number = isinstance(kind, NumericType)
        text = F.to_json(value) if isinstance(kind, (StructType, ArrayType, MapType)) else value.cast("string")
        return F.when(F.expr(q.where) if q.where else F.lit(True), F.struct(
            F.lit(q.id).alias("query_uid"), F.expr(q.key).cast("string").alias("key"), F.lit(q.reduce).alias("_kind"),
            (value.cast("double") if is_number else F.lit(None).cast("double")).alias("_number"),
            (text if not is_number or q.reduce == "union" else F.lit(None).cast("string")).alias("_text")))

    tagged = df.select(time, *order, F.inline(F.array_compact(F.array(*map(record, queries)))))
    kinds = {q.reduce for q in queries}

    def of(column: str, *kind: str) -> Column:
        return F.when(F.col("_kind").isin(*kind), F.col(column))

    tagged = tagged.withColumn("_added", of("_number", "sum", "average"))
    place = F.struct(*order) if order else F.lit(0)
    made = {"sum": [total.alias("_total")], "min": [F.min(of(c, "min")).alias(f"_min{c}") for c in ("_number", "_text")],
            "max": [F.max(of(c, "max")).alias(f"_max{c}") for c in ("_number", "_text")],
            "union": [F.sort_array(F.collect_set(of("_text", "union"))).alias("_members")],
            "first": [F.min_by(of(c, "first"), place).alias(f"_first{c}") for c in ("_number", "_text")]}
    made["average"] = made["sum"]
    columns = [c for k in dict.fromkeys("sum" if k == "average" else k for k in MIXED if k in kinds) for c in made[k]]
    reduced = tagged.groupBy(F.window(time, window), "query_uid", "key").agg(
        F.first("_kind").alias("_kind"), F.count(F.coalesce(F.col("_number").cast("string"), F.col("_text"))).alias("n"), *columns)
    have = set(reduced.columns)

    def result(choices: dict[str, Column], none: str) -> Column:
        out = F.lit(None).cast(none)
        for kind, column in choices.items():
            if kind in kinds:
                out = F.when(F.col("_kind") == kind, column).otherwise(out)
        return out

    number = {"sum": F.col("_total"), "average": F.try_divide(F.col("_total"), F.col("n"))} if "_total" in have else {}
    number |= {k: F.col(f"_{k}_number") for k in ("min", "max", "first") if k in kinds}
    text = {k: F.col(f"_{k}_text") for k in ("min", "max", "first") if k in kinds}
    members = {"union": F.col("_members")} if "union" in kinds else {}
    return reduced.select("query_uid", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          "key", result(number, "double").alias("number"), "n", result(text, "string").alias("text"),
                          result(members, "array<string>").alias("members"))
