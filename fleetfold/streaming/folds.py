"""Reductions of a stream by an opaque Python function, in windows of event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 16
_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


def fold_windows(stream: DataFrame, key: str | Sequence[str], value: str, fold: Callable, window: str, time: str = "ts",
                 slots: int = SLOTS) -> DataFrame:
    """``operators.reduce.custom_reduce_windowed`` on a stream that has a watermark on ``time``; output is append only.

    ``fold`` is associative and commutative. State is one running value per window, key and slot; rows are spread over
    ``slots`` by their content, so a hot key is spread. When the watermark passes a window's end, a timer sends its running
    values on to a second reduction by window and key alone, which emits one row and forgets the window.
    """
    keys = [key] if isinstance(key, str) else list(key)
    span = F.window(time, window)
    rows = stream.select(F.unix_micros(span.start).alias("window_start"), F.unix_micros(span.end).alias("window_end"),
                         *keys, F.pmod(F.xxhash64(time, value), F.lit(slots)).cast("int").alias("slot"),
                         F.col(time).alias("at"), F.col(value).alias("value"))
    kinds = [T.StructField(k, stream.schema[k].dataType) for k in keys]
    spans = [T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType())]
    kind = stream.schema[value].dataType
    last = [T.StructField("value", kind), T.StructField("at", T.TimestampType())]

    def folded(df: DataFrame, by: list[str], out: list[T.StructField]) -> DataFrame:
        return df.groupBy(*by).transformWithState(
            statefulProcessor=WindowFold(fold, kind, by), outputStructType=T.StructType(out), outputMode="append",
            timeMode="EventTime", eventTimeColumnName="at")

    whole = [f.name for f in spans + kinds]
    parts = folded(rows, [*whole, "slot"], [*spans, *kinds, T.StructField("slot", T.IntegerType()), *last])
    done = folded(parts, whole, [*spans, *kinds, *last])
    return done.select(*[F.timestamp_micros(f.name).alias(f.name) for f in spans], *keys, F.col("value").alias(value))


class WindowFold(StatefulProcessor):
    """One running value per group, whose key has the window's end in second place, until that has passed."""

    def __init__(self, fold: Callable, kind: T.DataType, names: list[str]) -> None:
        self._fold, self._kind, self._names = fold, kind, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._value = handle.getValueState("value", T.StructType([T.StructField("value", self._kind)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._value.exists()
        value = _plain(self._value.get()[0]) if known else None
        for r in rows:
            value, known = (self._fold(value, r.value) if known else r.value), True
        if timerValues.getCurrentWatermarkInMs() * 1000 >= key[1]:
            # Behind the first reduction: its timers fire together, so this batch has all values of the window.
            self._value.clear()
            return iter([self._row(key, value)])
        self._value.update((value,))
        self._handle.registerTimer(key[1] // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self._value.exists():
            return iter([])
        value = _plain(self._value.get()[0])
        self._value.clear()
        return iter([self._row(key, value)])

    def _row(self, key, value) -> Row:
        # The end itself belongs to the next window, so the last moment of this one is its time.
        return Row(**dict(zip(self._names, key)), value=value, at=_START + timedelta(microseconds=key[1] - 1))

    def close(self) -> None:
        pass


def _plain(value):
    """Nested rows of the state as the dictionaries that the function works on."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value
