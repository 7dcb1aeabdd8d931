"""Log audits on small logs worked out by hand."""

from statistics import mean, median, pvariance

import pytest

from fleetfold.operators import audit
from fleetfold.sources.readers import message_log, node_logs
from fleetfold.workload import queries
from fleetfold.workload import tables as t

A, B, C, D = (f"{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}" for c in "abcd")
LOG = [
    f"DEBUG OutSocketManager trying to send {A}", f"DEBUG OutSocketManager trying to send {B}",
    f"DEBUG OutSocketManager trying to send {B}", f"DEBUG OutSocketManager trying to send {C}",
    f"DEBUG NetworkLayer message 1 from: 2 got {A}", f"DEBUG NetworkLayer message 1 from: 2 got {D}",
    f"DEBUG from 2 queueing {A}", f"DEBUG Consensus commit {B} {A}", f"DEBUG Consensus commit {B} {A}",
    f"DEBUG Consensus commit {A} {C}", f"DEBUG Consensus abort {C}", "ERROR: unexpected message",
    "DEBUG trying to start new round on epoch 2024-01-01T00:00:04Z",
    "DEBUG trying to start new round on epoch 2024-01-01T00:01:04Z", "DEBUG idle",
]


@pytest.fixture(scope="module")
def parsed(spark):
    return audit.parse_messages(spark.createDataFrame([(line,) for line in LOG], "line string"))


def ids(df):
    return sorted(r["uuid"] for r in df.collect())


def test_reconciliation(parsed):
    flags = audit.message_flags(parsed)
    assert ids(audit.unreceived(flags)) == [B, C]
    assert ids(audit.lost_but_committed(flags)) == [B, C]
    assert ids(audit.unqueued(flags)) == [D]


def test_commit_pairs(parsed):
    row = audit.commit_pair_audit(parsed).first()
    assert (row["pairs"], row["fewest"], row["most"], row["odd_pairs"]) == (2, 1, 2, 1)
    assert [tuple(r) for r in audit.odd_commit_pairs(parsed).collect()] == [(A, C, 1)]
    assert audit.reversed_pairs(parsed).count() == 0


def test_reversed_pair_is_found(spark):
    lines = spark.createDataFrame([(f"Consensus commit {A} {B}",), (f"Consensus commit {B} {A}",)], "line string")
    assert audit.reversed_pairs(audit.parse_messages(lines)).count() == 1


def test_totals_and_rounds(parsed):
    row = audit.message_totals(parsed).first()
    assert (row["errors"], row["aborts"], row["sent"], row["received"]) == (1, 1, 4, 2)
    assert [tuple(r) for r in audit.rounds_per_epoch(parsed).collect()] == [(":04Z", 2)]


def test_violations(spark, parsed):
    assert audit.message_violations(parsed).count() == 0
    bad = ["Consensus abort null", f"Consensus commit {A}", "start new round", "queueing nothing"]
    rows = audit.message_violations(audit.parse_messages(spark.createDataFrame([(b,) for b in bad], "line string")))
    assert {r["line"] for r in rows.collect()} == set(bad)


def test_singletons(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    assert [r["x"] for r in audit.singletons(df, "x").collect()] == [2]


def write_logs(root, logs):
    for node, lines in logs.items():
        (root / node).mkdir(parents=True)
        (root / node / "output.log").write_text("\n".join(lines) + "\n")


def result(avg, epoch, total=None):
    number = f"[op=avg, item=ids]={avg}" + ("" if total is None else f", [op=sum, item=ids]={total}")
    return f"12:00 ERROR FINAL RESULT: {{{number}}} EPOCH: {epoch}"


def test_node_logs(spark, tmp_path):
    write_logs(tmp_path / "logs", {
        "0-CLUSTERHEAD": [result(1.0, "e1", 10.0), "noise", result("1.5E1", "e2")],
        "1": [result(7.0, "e1"), "noise", result(9.0, "e1"), result(2.0, "e1"), "FINAL RESULT: {} EPOCH: e2"],
    })
    lines = node_logs(spark, str(tmp_path / "logs"))
    assert {r["node"] for r in lines.collect()} == {"0-CLUSTERHEAD", "1"}
    parsed = audit.parse_results(lines)
    values = audit.averages(parsed)
    assert {(r["epoch"], r["value"]) for r in values.collect()} == {("e1", 1.0), ("e2", 15.0), ("e1", 2.0)}
    assert parsed.count() == 6
    assert {(r["epoch"], r["value"]) for r in audit.head_epochs(values).collect()} == {("e1", 1.0), ("e2", 15.0)}
    assert [tuple(r) for r in audit.incomplete_epochs(values).collect()] == [("e2", 1)]
    assert {(r["op"], r["value"]) for r in audit.results_by_op(parsed).collect()} == {
        ("avg", 1.0), ("avg", 2.0), ("avg", 15.0), ("sum", 10.0)}


def test_message_log_file(spark, tmp_path):
    (tmp_path / "m.log").write_text("\n".join(LOG))
    assert message_log(spark, str(tmp_path / "m.log")).count() == len(LOG)


@pytest.mark.parametrize("small", [100_000, 0])
def test_error_statistics(spark, monkeypatch, small):
    monkeypatch.setattr(audit, "SMALL_EPOCH", small)
    groups = {"e1": [1.0, 2.0, 4.0, 4.0], "e2": [0.5, 2.5]}
    df = spark.createDataFrame([(f"n{i}", e, v) for e, vs in groups.items() for i, v in enumerate(vs)],
                               "path string, epoch string, value double")
    rows = {r["epoch"]: r for r in audit.epoch_error_stats(df).collect()}
    for e, vs in groups.items():
        errors = [abs(v - 1.5) * 100 / 1.5 for v in vs]
        got = [rows[e][c] for c in ("median", "mean", "variance", "mean_error", "participation", "max_error", "median_error")]
        assert got == pytest.approx(
            [median(vs), mean(vs), pvariance(vs), mean(errors), len(vs) * 25.0, max(errors), median(errors)])


def test_one_node_has_no_percent_error(spark):
    df = spark.createDataFrame([("n0", "e", 3.0)], "path string, epoch string, value double")
    row = audit.epoch_error_stats(df).first()
    assert row["median"] == 3.0 and row["max_error"] is None and row["participation"] == 100.0


def test_convergence_summary(spark):
    rows = [(f"e{i:03d}", 100.0 if i >= 5 else 50.0, float(i)) for i in range(100)]
    stats = spark.createDataFrame(rows, "epoch string, participation double, max_error double")
    row = audit.convergence_summary(stats).first()
    want = [float(i) for i in range(15, 65)]
    assert row["epochs"] == 50 and row["median"] == median(want) and row["mean"] == mean(want)
    assert row["variance"] == pytest.approx(pvariance(want))
    none = audit.convergence_summary(stats.where("participation < 100")).first()
    assert none["epochs"] == 0 and none["mean"] is None


def test_every_message_of_the_log_commits(spark, sf_dir):
    kinds = {r["kind"]: r["lines"] for r in queries()["parse_message_log"](spark, sf_dir).collect()}
    slow = t.status(spark, sf_dir).where("mph <= 100").count()
    assert kinds["commit"] == kinds["send"] + slow


def test_commit_pairs_of_all_messages(spark, sf_dir):
    row = queries()["commit_pair_audit"](spark, sf_dir).first()
    assert row["pairs"] == t.status(spark, sf_dir).count()


def test_odd_commit_pairs_of_the_fastest(spark, sf_dir):
    fast = t.status(spark, sf_dir).where("mph > 100").count()
    assert queries()["odd_commit_pairs"](spark, sf_dir).count() == fast
    assert t.status(spark, sf_dir).where("mph > 180").count() > 0
