"""Holding messages back while an epoch is set up, and releasing them when it starts.

A node delivers messages of its current epoch, drops those of an earlier one
and holds those of a later one. While a new epoch is being set up it holds
everything. A node starts out holding.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RELEASED = "node bigint, slot int, item bigint, epoch bigint, released bigint"
SLOTS = 16


def release_by_epoch(messages: DataFrame, control: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Delivered messages with the time of their delivery, in microseconds.

    ``messages`` is (node, at, epoch, item) and ``control`` is (node, at, kind,
    epoch) with kind ``hold`` or ``set``; times and epochs are whole numbers. A
    message depends on control rows only, never on other messages, so a node's
    messages are spread over ``slots`` and its control rows go to each of them.
    """
    spread = messages.select(
        "node", F.pmod(F.hash("item"), F.lit(slots)).alias("slot"), "at", F.lit("message").alias("kind"),
        "epoch", "item")
    everywhere = control.select(
        "node", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "at", "kind", "epoch",
        F.lit(0).cast("bigint").alias("item"))
    return spread.unionByName(everywhere).groupBy("node", "slot").transformWithStateInPandas(
        statefulProcessor=EpochGate(), outputStructType=RELEASED, outputMode="append", timeMode="none")


class EpochGate(StatefulProcessor):
    """State per (node, slot): whether it holds, its epoch, and the messages held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._mode = handle.getValueState("mode", "holding boolean, epoch bigint")
        self._held = handle.getListState("held", "item bigint, epoch bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        node, slot = key
        frames = list(rows)
        columns = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at", "kind", "epoch")}
        items = np.concatenate([f["item"].to_numpy(dtype="int64") for f in frames])
        is_message = columns["kind"] == "message"
        # At one moment control comes first.
        order = np.lexsort((is_message, columns["at"]))
        at, kind, epochs = (columns[c][order] for c in ("at", "kind", "epoch"))
        items, is_message = items[order], is_message[order]

        holding, epoch = self._mode.get() if self._mode.exists() else (True, None)
        kept = list(self._held.get())
        held_items = np.array([k[0] for k in kept], dtype="int64")
        held_epochs = np.array([k[1] for k in kept], dtype="int64")
        out = []
        # One segment per control row: that row, then the messages up to the next.
        starts = np.concatenate([[-1], np.flatnonzero(~is_message), [len(at)]])
        for start, end in zip(starts[:-1], starts[1:]):
            if start >= 0:
                holding = kind[start] == "hold"
                if not holding:
                    epoch = int(epochs[start])
                    due = held_epochs == epoch
                    out.append((held_items[due], held_epochs[due], np.full(due.sum(), at[start])))
                    held_items, held_epochs = held_items[held_epochs > epoch], held_epochs[held_epochs > epoch]
            new = slice(start + 1, end)
            later = np.full(end - start - 1, True) if holding else epochs[new] > epoch
            held_items = np.concatenate([held_items, items[new][later]])
            held_epochs = np.concatenate([held_epochs, epochs[new][later]])
            if not holding:
                now = epochs[new] == epoch
                out.append((items[new][now], epochs[new][now], at[new][now]))

        self._mode.update((bool(holding), epoch))
        if len(held_items):
            self._held.put(list(zip(held_items.tolist(), held_epochs.tolist())))
        else:
            self._held.clear()
        item, of_epoch, released = (np.concatenate(parts) for parts in zip(*out)) if out else ([], [], [])
        if len(item):
            yield pd.DataFrame({"node": node, "slot": slot, "item": item, "epoch": of_epoch, "released": released})

    def close(self) -> None:
        pass
