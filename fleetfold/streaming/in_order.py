"""Stateful operators that play a stream's rows in event-time order, whatever batches they arrive in.

A streaming aggregation holds a row until the watermark has passed its time; then the rows that are due go to their
shard, a hash of their key, where one call of Python plays them in order and keeps what outlasts them. So Python sees a row once
and is called per shard and batch, not per key. The outcome depends only on the rows and the watermark's delay, not on how
files fall into batches or rows into files. A row later than the delay allows is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timedelta, timezone
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 16
SHARDS = 1024
RELEASED = "node bigint, slot int, item bigint, epoch bigint, released timestamp"
_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


def release_in_order(messages: DataFrame, control: DataFrame, delay: str = "1 minute", slots: int = SLOTS,
                     expire: str | None = None) -> DataFrame:
    """Messages delivered to their nodes, with the time of their delivery, by event time.

    ``messages`` is (node, at, epoch, item) and ``control`` (node, at, kind, epoch) with kind ``hold`` or
    ``set``; ``at`` is a timestamp, epochs and items are whole numbers. A node starts out holding. While it holds, every
    message is kept; ``set`` makes an epoch the current one, which releases the messages kept for it and drops those kept
    for earlier ones. Otherwise a message of the current epoch is delivered at once, one of a later epoch is kept, one of an
    earlier epoch dropped. At one moment control comes first.

    ``expire`` bounds the state: a message kept for longer is dropped. Rows with a null time, epoch (of a message or a
    ``set``) or item are left out. A message depends on control rows only, so a node's messages
    are spread over ``slots``, and its control rows go to each.
    """
    kept_for = None if expire is None else _micros(expire)
    sent = messages.where("at is not null and epoch is not null and item is not null").withWatermark("at", delay)
    told = control.where("at is not null and (kind = 'hold' or kind = 'set' and epoch is not null)").withWatermark("at", delay)
    spread = sent.select("node", F.pmod(F.xxhash64("item"), F.lit(slots)).cast("int").alias("slot"), "at",
                         F.unix_micros("at").alias("us"), F.lit(1).alias("rank"), "epoch", "item",
                         F.lit("message").alias("kind"))
    everywhere = told.select("node", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "at",
                             F.unix_micros("at").alias("us"), F.lit(0).alias("rank"),
                             F.coalesce("epoch", F.lit(0).cast("bigint")).alias("epoch"), F.lit(0).cast("bigint").alias("item"), "kind")
    return _due(spread.union(everywhere), "node", "slot").transformWithState(
        statefulProcessor=EpochGate(kept_for), outputStructType=RELEASED, outputMode="append", timeMode="EventTime",
        eventTimeColumnName="released")


def as_of_in_order(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str,
                   delay: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """Adds to each row of a stream the right stream's value with the greatest time not after the row's own.

    The stream form of ``operators.scans.as_of``: null where no earlier right row is, at equal times of one key the greatest
    value holds. Per key one value and the rows of the delay are in state. Rows of either side with a null time are left out,
    and right rows with a null key, too. A key's left rows are spread over ``slots``; its right rows go to each.
    The result keeps the watermark on ``left_time``, so that a windowed reduction can follow.
    """
    kind = right.schema[value].dataType
    facts = left.where(F.col(left_time).isNotNull())
    facts = facts.withColumn(left_time, F.col(left_time).cast("timestamp")).withWatermark(left_time, delay)
    news = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    news = news.withColumn(right_time, F.col(right_time).cast("timestamp")).withWatermark(right_time, delay)
    packed = F.struct(*[_portable(f).alias(f.name) for f in left.schema])
    shape = facts.select(packed.alias("fact")).schema["fact"].dataType
    body = F.to_json(packed)
    rows = facts.select(_id(F.col(key), F.pmod(F.xxhash64(body), F.lit(slots)).cast("int")).alias("id"),
                        F.col(left_time).alias("at"), F.unix_micros(left_time).alias("us"), F.lit(1).alias("rank"), body.alias("body"))
    news = news.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    changes = news.select(_id(F.col(key).cast(left.schema[key].dataType), F.col("_slot")).alias("id"), F.col(right_time).alias("at"), F.unix_micros(right_time).alias("us"), F.lit(0).alias("rank"),
                          F.to_json(F.struct(F.col(value).alias("value"))).alias("body"))
    held = _due(rows.union(changes), "id").transformWithState(
        statefulProcessor=LatestValue(), outputStructType="_at timestamp, fact string, value string", outputMode="append",
        timeMode="EventTime", eventTimeColumnName="_at")
    held = held.select("_at", F.from_json("fact", shape).alias("fact"),
                       F.from_json("value", T.StructType([T.StructField("value", kind)]))["value"].alias("value"))
    columns = [F.col("_at").alias(left_time) if f.name == left_time else _restored(f).alias(f.name) for f in left.schema]
    return held.select(*columns, F.col("value").alias(value))


def set_changes_in_order(snapshots: DataFrame, keys: Sequence[str], time: str, every: str, delay: str = "1 minute") -> DataFrame:
    """Entries that appear in or vanish from the snapshots of a stream: ``keys``, ``at`` and ``change`` (started or stopped).

    The stream form of ``operators.reduce.set_changes`` over any number of snapshots. A snapshot is the rows of one ``time``, and
    there is one per ``every``. An entry starts with the first snapshot that holds it and stops, by a timer, at the first one that
    does not; it may start again. State is a time per entry that is in the set. Rows without a time are left out.
    """
    rows = snapshots.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("timestamp").alias("at")).withWatermark("at", delay)
    rows = rows.select(_id(*keys).alias("id"), *keys, "at", F.unix_micros("at").alias("us"))
    out = T.StructType([*[T.StructField(k, snapshots.schema[k].dataType) for k in keys],
                        T.StructField("at", T.TimestampType()), T.StructField("change", T.StringType())])
    return _due(rows, "id").transformWithState(
        statefulProcessor=Presence(out.fields[:len(keys)], _micros(every)), outputStructType=out, outputMode="append", timeMode="EventTime")


def running_total_in_order(rows: DataFrame, keys: Sequence[str], time: str, value: Column | str, name: str, ties: Sequence[str] = (),
                           bucket: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """Cumulative sum of whole numbers per key in (time, ties) order, over all batches of a stream.

    The stream form of ``operators.scans.running_total``. Rows are split by (key, ``bucket``): a bucket's sum becomes final once the
    watermark has passed it, the total of the buckets before it is kept per key, and then the bucket's own rows are played from
    there on. So a hot key is spread over its buckets, only one row of each passes through the key's task, and state
    is a total per key and the rows of open buckets; take buckets one of which fits a task. A null amount counts as 0, a
    null key is a key, rows without a time or later than ``delay`` are left out.
    """
    width = _micros(bucket)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    amount = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    packed = F.struct(*[_portable(f).alias(f.name) for f in rows.schema])
    order = F.struct(us.alias("us"), *[F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)], F.to_json(packed).alias("body"),
                     F.coalesce(amount, F.lit(0).cast("bigint")).alias("amount"))
    parts = rows.where(F.col(time).isNotNull()).select(
        *keys, F.timestamp_micros(us - F.pmod(us, F.lit(width)) + width).alias("_end"), order.alias("_row"))
    # Buckets close as wholes, so the watermark follows their ends and waits a bucket longer.
    parts = parts.withWatermark("_end", f"{_micros(delay) + width} microseconds")
    sums = parts.groupBy(*keys, "_end").agg(F.sum("_row.amount").alias("_amount")).select(
        _id(*keys).alias("id"), *keys, "_end", F.unix_micros("_end").alias("_us"), "_amount")
    key_fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    before = T.StructType([*key_fields, T.StructField("_end", T.TimestampType()), T.StructField("_before", T.LongType())])
    carried = sums.withColumn("shard", _shard("id")).groupBy("shard").transformWithState(
        statefulProcessor=BucketsBefore(list(keys)), outputStructType=before, outputMode="append", timeMode="EventTime",
        eventTimeColumnName="_end")
    carried = carried.select(*keys, "_end", F.lit(None).cast(parts.schema["_row"].dataType).alias("_row"), "_before")
    both = parts.withColumn("_before", F.lit(None).cast("bigint")).union(carried)
    closed = both.groupBy(*keys, "_end").agg(F.sort_array(F.collect_list("_row")).alias("_rows"), F.max("_before").alias("_before"))
    totals = closed.select("_rows.body", _running_sums()("_rows.amount", "_before").alias("total"))
    totals = totals.select(F.inline(F.arrays_zip("body", "total")))
    shape = rows.select(packed.alias("row")).schema["row"].dataType
    restored = totals.select(F.from_json("body", shape).alias("fact"), "total")
    return restored.select(*[_restored(f).alias(f.name) for f in rows.schema], F.col("total").alias(name))


def _due(rows: DataFrame, *spread: str):
    """Rows that the watermark on ``at`` has passed, by the shard of their ``spread`` columns; equal rows are one with their number ``n``."""
    held = rows.withColumn("shard", _shard(*spread))
    return held.groupBy(*held.columns).agg(F.count(F.lit(1)).alias("n")).groupBy("shard")


def _shard(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SHARDS)).cast("int")


def _id(*columns: Column | str) -> Column:
    """Values of any types as text, by which Python tells keys apart."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(named)]))


def _running_sums():
    import pandas as pd

    def sums(amounts, before):
        return pd.Series([list(accumulate((int(x) for x in each), initial=int(start)))[1:] for each, start in zip(amounts, before)])

    sums.__annotations__ = {"amounts": pd.Series, "before": pd.Series, "return": pd.Series}
    return F.pandas_udf(sums, "array<bigint>")


def _portable(field: T.StructField) -> Column:
    """Times as whole microseconds, which Python holds without a time zone."""
    column = F.col(field.name)
    return F.unix_micros(column.cast("timestamp")) if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)) else column


def _restored(field: T.StructField) -> Column:
    column = F.col(f"fact.{field.name}")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(column).cast(field.dataType)
    return column


def _micros(span: str) -> int:
    """A length of time such as ``2 hours`` in microseconds."""
    number, unit = span.split()
    return int(timedelta(**{unit.rstrip("s") + "s": float(number)}) / timedelta(microseconds=1))


def _moment(us: int) -> datetime:
    return _START + timedelta(microseconds=us)


class InOrder(StatefulProcessor):
    """Gets the rows of a shard that are due, each batch's later than all before; its state is one value, made of lists."""

    state_type: T.StructType | str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", self.state_type)

    def play(self, rows: Iterable[Row], until: int) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self.play(rows, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.play((), timerValues.getCurrentWatermarkInMs() * 1000)

    def known(self) -> tuple | None:
        return tuple(self._state.get()) if self._state.exists() else None

    def _wake(self, us: int) -> None:
        """Calls back once the watermark has passed the millisecond of a time."""
        self._handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


class EpochGate(InOrder):
    """State per (node, slot): whether it holds, its epoch, and the messages kept, by epoch."""

    state_type = """nodes array<bigint>, slots array<int>, holding array<boolean>, epochs array<bigint>, gates array<int>,
        kept array<bigint>, items array<bigint>, times array<bigint>"""

    def __init__(self, kept_for: int | None) -> None:
        self._kept_for = kept_for

    def play(self, rows: Iterable[Row], until: int) -> Iterator[Row]:
        gates = self._read()
        out = []
        for r in sorted(rows, key=lambda r: (r.us, r.rank, r.kind, r.epoch)):
            gate = gates.setdefault((r.node, r.slot), [True, None, {}])
            holding, epoch, kept = gate
            self._drop_old(kept, r.us)
            if r.kind == "hold":
                gate[0] = True
            elif r.kind == "set":
                out += [(r.node, r.slot, i, r.epoch, r.us) for i, _ in kept.pop(r.epoch, [])]
                gate[:] = False, r.epoch, {k: v for k, v in kept.items() if k > r.epoch}
            elif holding or r.epoch > epoch:
                kept.setdefault(r.epoch, []).extend([(r.item, r.us)] * r.n)
            elif r.epoch == epoch:
                out += [(r.node, r.slot, r.item, r.epoch, r.us)] * r.n
        for _, _, kept in gates.values():
            self._drop_old(kept, until)
        self._write(gates)
        return iter([Row(node=node, slot=slot, item=i, epoch=of, released=_moment(us)) for node, slot, i, of, us in out])

    def _read(self) -> dict:
        known = self.known()
        if known is None:
            return {}
        nodes, slots, holding, epochs, at, kept, items, times = known
        gates = [[h, e, {}] for h, e in zip(holding, epochs)]
        for g, of, item, us in zip(at, kept, items, times):
            gates[g][2].setdefault(of, []).append((item, us))
        return dict(zip(zip(nodes, slots), gates))

    def _write(self, gates: dict) -> None:
        held = [(g, of, item, us) for g, gate in enumerate(gates.values()) for of, v in gate[2].items() for item, us in v]
        self._state.update((
            [k[0] for k in gates], [k[1] for k in gates], [g[0] for g in gates.values()], [g[1] for g in gates.values()],
            *[[h[i] for h in held] for i in range(4)]))
        if self._kept_for is not None and held:
            self._wake(min(h[3] for h in held) + self._kept_for)

    def _drop_old(self, kept: dict, now: int) -> None:
        if self._kept_for is None:
            return
        for k in list(kept):
            kept[k] = [(i, t) for i, t in kept[k] if t + self._kept_for >= now]
            if not kept[k]:
                del kept[k]


class LatestValue(InOrder):
    """State per (key, slot): the value that holds. Rows and values are JSON, which keeps all types as they are."""

    state_type = "ids array<string>, vals array<string>"

    def order(self, row: Row):
        if row["rank"]:
            return row["id"], row["us"], 1
        value = json.loads(row["body"]).get("value")
        return (row["id"], row["us"], 0, 0) if value is None else (row["id"], row["us"], 0, 1, value)

    def play(self, rows: Iterable[Row], until: int) -> Iterator[Row]:
        values = dict(zip(*(self.known() or ((), ()))))
        out = []
        for r in sorted(rows, key=self.order):
            if r["rank"] == 0:
                values[r["id"]] = r["body"]
            else:
                out += [Row(_at=_moment(r["us"]), fact=r["body"], value=values.get(r["id"], "{}"))] * r["n"]
        if values:
            self._state.update((list(values), list(values.values())))
        return iter(out)


class Presence(InOrder):
    """State per entry that is in the set: the time of the last snapshot that held it."""

    def __init__(self, keys: list[T.StructField], every: int) -> None:
        self._names, self._every = [f.name for f in keys], every
        entry = T.StructType([T.StructField("id", T.StringType()), T.StructField("key", T.StructType(keys)), T.StructField("us", T.LongType())])
        self.state_type = T.StructType([T.StructField("entries", T.ArrayType(entry))])

    def play(self, rows: Iterable[Row], until: int) -> Iterator[Row]:
        known = self.known()
        last = {e[0]: (tuple(e[1]), e[2]) for e in known[0]} if known else {}
        out = []

        def tell(key: tuple, us: int, change: str) -> None:
            out.append(Row(**dict(zip(self._names, key)), at=_moment(us), change=change))

        for r in sorted(rows, key=lambda r: r["us"]):
            key, seen = last.get(r["id"], (tuple(r[k] for k in self._names), None))
            if seen is not None and r["us"] > seen + self._every:
                tell(key, seen + self._every, "stopped")
                seen = None
            if seen is None:
                tell(key, r["us"], "started")
            last[r["id"]] = key, r["us"]
        for id_, (key, seen) in list(last.items()):
            if seen + self._every <= until:
                tell(key, seen + self._every, "stopped")
                del last[id_]
        if last:
            self._state.update(([(id_, key, seen) for id_, (key, seen) in last.items()],))
            self._wake(min(seen for _, seen in last.values()) + self._every)
        else:
            self._state.clear()
        return iter(out)


class BucketsBefore(InOrder):
    """State per key: the total of all closed buckets. Buckets close in the order of their ends, so a batch's are later than all before."""

    state_type = "ids array<string>, totals array<bigint>"

    def __init__(self, names: list[str]) -> None:
        self._names = names

    def play(self, rows: Iterable[Row], until: int) -> Iterator[Row]:
        totals = dict(zip(*(self.known() or ((), ()))))
        out = []
        for r in sorted(rows, key=lambda r: r["_us"]):
            total = totals.get(r["id"], 0)
            out.append(Row(**{k: r[k] for k in self._names}, _end=_moment(r["_us"]), _before=total))
            totals[r["id"]] = total + r["_amount"]
        self._state.update((list(totals), list(totals.values())))
        return iter(out)
