"""Queries declared with Python functions in place of SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.operators.reduce import custom_reduce, custom_reduce_windowed
from fleetfold.streaming.folds import SLOTS, fold_windows


@dataclass(frozen=True)
class FunctionQuery:
    """A filter, a map to (key, value) and a reduction by key, each a Python function.

    ``map`` turns a pandas frame of ``columns`` into one with columns ``key`` and ``value`` of the declared types, row by row;
    ``where`` turns it into a boolean series; ``fold`` merges two values, in any order. The first two run over Arrow batches, and only
    ``columns`` are read. Prefer ``MapReduceQuery`` where SQL can say it: that is optimised and stays in generated code.
    Two queries are the same when their id is.
    """

    id: str
    columns: Sequence[str]
    map: Callable
    key_type: str
    value_type: str
    fold: Callable | None = None
    where: Callable | None = None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FunctionQuery) and self.id == other.id

    def __hash__(self) -> int:
        return hash(self.id)

    def mapped(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Filter, then map, on a batch frame or a stream; ``keep`` passes columns on beside key and value."""
        row = F.struct(*self.columns)
        if self.where is not None:
            df = df.where(F.coalesce(_over_frames(self.where, "boolean")(row), F.lit(False)))
        pair = _over_frames(self.map, f"struct<key: {self.key_type}, value: {self.value_type}>")(row)
        return df.select(*keep, pair.alias("_pair")).select(*keep, "_pair.key", "_pair.value")

    def run(self, df: DataFrame) -> DataFrame:
        """All rows of a batch frame reduced by key."""
        return custom_reduce(self.mapped(df), "key", "value", self._folding())

    def run_windowed(self, df: DataFrame, window: str, time: str = "ts", slots: int = SLOTS) -> DataFrame:
        """Rows reduced by key in tumbling event-time windows; a stream needs a watermark on ``time``."""
        rows = self.mapped(df, [time])
        if df.isStreaming:
            return fold_windows(rows, "key", "value", self._folding(), window, time, slots)
        return custom_reduce_windowed(rows, "key", "value", self._folding(), window, time)

    def _folding(self) -> Callable:
        if self.fold is None:
            raise ValueError(f"query {self.id!r} has no reduction")
        return self.fold


def _over_frames(fn: Callable, returned: str) -> Callable:
    import pandas as pd

    def run(frame):
        return fn(frame)

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame if returned.startswith("struct") else pd.Series}
    return F.pandas_udf(run, returned)
