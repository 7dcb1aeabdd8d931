"""Stateful operators that get all keys of a shard in one call, without a stream."""

from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import types as T

from fleetfold.streaming.in_order import BucketsBefore, EpochGate, LatestValue, Presence


class OneValue:
    """A state of one value that counts how often it is written."""

    def __init__(self):
        self.value, self.writes, self.timers = None, 0, []

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


def started(processor):
    state = OneValue()
    processor.init(SimpleNamespace(getValueState=lambda *a: state, registerTimer=state.timers.append))
    return state


def calls(processor, *batches):
    """Outcome of batches of (watermark, rows)."""
    for mark, rows in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        yield [tuple(r) for r in processor.handleInputRows((0,), iter([Row(**r) for r in rows]), clock)]


def test_totals_of_many_keys_in_one_call():
    processor = BucketsBefore(["relay"])
    state = started(processor)
    batch = [{"id": str(k), "relay": k, "_us": us, "_amount": k + us} for us in (2, 1) for k in range(50)]
    first, second = calls(processor, (1, batch), (2, [{"id": "7", "relay": 7, "_us": 9, "_amount": 1}]))
    assert {(r[0], r[2]) for r in first} == {(k, 0) for k in range(50)} | {(k, k + 1) for k in range(50)}
    assert [(r[0], r[2]) for r in second] == [(7, 17)] and state.writes == 2


def test_latest_values_of_many_keys_in_one_call():
    processor = LatestValue()
    state = started(processor)
    news = [{"id": str(k), "us": 1, "rank": 0, "body": f'{{"value":{k}}}', "n": 1} for k in range(50)]
    facts = [{"id": str(k), "us": 1, "rank": 1, "body": f"f{k}", "n": 2} for k in range(51)]
    first, second = calls(processor, (1, facts + news), (2, [{"id": "3", "us": 5, "rank": 1, "body": "late", "n": 1}]))
    want = [(f"f{k}", f'{{"value":{k}}}' if k < 50 else "{}") for k in range(51) for _ in range(2)]
    assert sorted(r[1:] for r in first) == sorted(want)
    assert [r[1:] for r in second] == [("late", '{"value":3}')] and state.writes == 2


def test_sets_of_many_entries_in_one_call():
    processor = Presence([T.StructField("node", T.LongType())], 1000)
    started(processor)
    rows = [{"id": str(k), "node": k, "us": 0, "n": 1} for k in range(20)]
    first, second = calls(processor, (0, rows), (1, [{"id": "4", "node": 4, "us": 1000, "n": 1}]))
    assert sorted((r[0], r[2]) for r in first) == [(k, "started") for k in range(20)]
    assert sorted((r[0], r[2]) for r in second) == [(k, "stopped") for k in range(20) if k != 4]


def test_epochs_of_many_nodes_in_one_call():
    processor = EpochGate(None)
    state = started(processor)
    sent = [{"node": k, "slot": 0, "us": 1, "rank": 1, "kind": "message", "epoch": 5, "item": k, "n": 1} for k in range(30)]
    told = [{"node": k, "slot": 0, "us": 2, "rank": 0, "kind": "set", "epoch": 5, "item": 0, "n": 1} for k in range(0, 30, 2)]
    first, second = calls(processor, (1, sent), (2, told))
    assert first == [] and sorted(r[2] for r in second) == list(range(0, 30, 2)) and state.writes == 2


def test_hold_and_set_at_one_moment_have_one_outcome():
    at = {"node": 0, "slot": 0, "us": 2, "rank": 0, "item": 0, "n": 1}
    sent = {"node": 0, "slot": 0, "us": 3, "rank": 1, "kind": "message", "epoch": 5, "item": 1, "n": 1}
    hold, tell = {**at, "kind": "hold", "epoch": 0}, {**at, "kind": "set", "epoch": 5}
    outcomes = []
    for control in ([hold, tell], [tell, hold]):
        processor = EpochGate(None)
        started(processor)
        outcomes.append(list(calls(processor, (1, [*control, sent]))))
    assert outcomes[0] == outcomes[1] and len(outcomes[0][0]) == 1
