"""Map and filter by opaque Python functions over Arrow batches.

Prefer column expressions: they are optimised and stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """``fn`` turns a pandas batch into a pandas batch of the given schema."""
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def filter_batches(df: DataFrame, fn: Callable) -> DataFrame:
    """``fn`` gives a boolean series that says which rows of a pandas batch stay."""
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch[fn(batch)]

    return df.mapInPandas(run, df.schema)
