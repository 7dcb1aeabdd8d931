"""Collects queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from fleetfold.plans.catalog import named_query
from fleetfold.plans.spec import MapReduceQuery
from fleetfold.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as wall-clock ones, the form the test tables use."""
    zoned = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, TimestampType)}
    return df.withColumns(zoned) if zoned else df


def stock(name: str) -> MapReduceQuery:
    """A stock query with sums exact to four decimals, so that they can be compared with the SQL check."""
    return replace(named_query(name), digits=4)


def query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    if name in _QUERIES:
        raise ValueError(f"query {name!r} is registered twice")

    def register(fn: QueryFn) -> QueryFn:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(prepare(spark), sf_dir))

        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return run

    return register


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
