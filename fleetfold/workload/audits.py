"""Audits of result logs and message logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetfold.operators import audit
from fleetfold.session import scratch_path
from fleetfold.sources.readers import message_log
from fleetfold.streaming.sinks import save_results
from fleetfold.workload import tables as t
from fleetfold.workload.registry import query
from fleetfold.workload.tables import check

_PATH = "concat('LogOutput/', kind, '-', node, '/output.log')"


def _values(spark, sf_dir):
    return audit.averages(audit.parse_results(t.gossip_log(spark, sf_dir)))


def _error_stats(spark, sf_dir):
    return audit.epoch_error_stats(_values(spark, sf_dir), audit.node_count(t.gossip_log(spark, sf_dir)))


@query("parse_gossip_log", check(f"""SELECT {_PATH} AS path, epoch, value AS avg, total AS sum FROM log
    UNION ALL SELECT {_PATH}, epoch, CAST(ROUND(value * 10000) + 10000 AS DOUBLE) / 10000.0, total FROM log
    WHERE (node + d) % 5 = 0""", "log"))
def parse_gossip_log(spark, sf_dir):
    return audit.parse_results(t.gossip_log(spark, sf_dir)).drop("position")


@query("head_epochs", check("SELECT epoch, value FROM log WHERE kind = 'CLUSTERHEAD'", "log"))
def head_epochs(spark, sf_dir):
    return audit.head_epochs(_values(spark, sf_dir))


@query("incomplete_epochs", check("""SELECT epoch, COUNT(*) AS members FROM log GROUP BY epoch
    HAVING COUNT(*) <> (SELECT COUNT(DISTINCT node) FROM log)""", "log"))
def incomplete_epochs(spark, sf_dir):
    return audit.incomplete_epochs(_values(spark, sf_dir))


_JUDGED = """sized AS (SELECT COUNT(DISTINCT node) AS n FROM log), judged AS (SELECT epoch, value, n,
    ABS(value - (n - 1) / 2.0::DOUBLE) * 100 / ((n - 1) / 2.0::DOUBLE) AS error FROM log, sized),
    stats AS (SELECT epoch, quantile_cont(value, 0.5) AS median, AVG(value) AS mean, VAR_POP(value) AS variance,
    AVG(error) AS mean_error, COUNT(*) * 100.0::DOUBLE / MAX(n) AS participation, MAX(error) AS max_error,
    quantile_cont(error, 0.5) AS median_error FROM judged GROUP BY epoch)"""
_STATS = ("median", "mean", "variance", "mean_error", "participation", "max_error", "median_error")


@query("epoch_error_stats", check("SELECT epoch, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _STATS)
                                  + " FROM stats", "log", more=_JUDGED))
def epoch_error_stats(spark, sf_dir):
    stats = _error_stats(spark, sf_dir)
    return stats.select("epoch", *[F.round(c, 6).alias(c) for c in _STATS])


@query("convergence_summary", check("""SELECT COUNT(*) AS epochs, ROUND(quantile_cont(max_error, 0.5), 6) AS median,
    ROUND(AVG(max_error), 6) AS mean, ROUND(VAR_POP(max_error), 6) AS variance
    FROM (SELECT *, row_number() OVER (ORDER BY epoch) AS rn FROM stats) r,
    (SELECT MIN(rn) AS first FROM (SELECT participation, row_number() OVER (ORDER BY epoch) AS rn FROM stats)
     WHERE participation = 100) f
    WHERE rn >= first + 10 AND rn < first + 60""", "log", more=_JUDGED))
def convergence_summary(spark, sf_dir):
    summary = audit.convergence_summary(_error_stats(spark, sf_dir))
    return summary.select("epochs", *[F.round(c, 6).alias(c) for c in ("median", "mean", "variance")])


def _parsed(spark, sf_dir, commits="true"):
    return audit.parse_messages(t.message_lines(spark, sf_dir, commits))


def _line_kinds_check(commits):
    return check(f"""SELECT kind, COUNT(*) AS lines, CAST(SUM(ids) AS BIGINT) AS ids FROM (
    SELECT 'send' AS kind, 1 AS ids FROM ids UNION ALL SELECT 'receive', 1 FROM ids WHERE mph <= 150
    UNION ALL SELECT 'queue', 1 FROM ids WHERE mph BETWEEN 2 AND 150
    UNION ALL SELECT 'commit', 2 FROM ids{commits} UNION ALL SELECT 'commit', 2 FROM ids WHERE mph <= 100
    UNION ALL SELECT 'abort', 1 FROM ids WHERE color = 'white' UNION ALL SELECT 'abort', 0 FROM ids WHERE mph > 300
    UNION ALL SELECT 'error', 0 FROM ids WHERE color = 'red' UNION ALL SELECT 'start', 0 FROM ids WHERE color = 'green'
    UNION ALL SELECT NULL, 0 FROM ids) GROUP BY kind""", "ids")


def _line_kinds(parsed):
    return parsed.groupBy("kind").agg(F.count("*").alias("lines"), F.sum(F.size("uuids")).alias("ids"))


@query("parse_message_log", _line_kinds_check(""))
def parse_message_log(spark, sf_dir):
    return _line_kinds(_parsed(spark, sf_dir))


@query("message_log_files", _line_kinds_check(" WHERE mph <= 180"))
def message_log_files(spark, sf_dir):
    path = scratch_path(spark, "messages")
    t.message_lines(spark, sf_dir, t.SLOW_COMMITS).write.text(path)
    return _line_kinds(audit.parse_messages(message_log(spark, path)))


@query("saved_results", check(f"""SELECT {_PATH} AS path, epoch, value,
    CASE kind WHEN 'CLUSTERHEAD' THEN 'heads' ELSE 'nodes' END AS run FROM log""", "log"))
def saved_results(spark, sf_dir):
    out, values = scratch_path(spark, "results"), _values(spark, sf_dir).select("path", "epoch", "value")
    heads = F.col("path").contains("CLUSTERHEAD")
    # The first results of the heads are of another run of theirs, which the second replaces.
    for run, rows in (("heads", values), ("nodes", values.where(~heads)), ("heads", values.where(heads))):
        save_results(rows, out, run)
    return spark.read.schema("path string, epoch string, value double, run string").json(out)


@query("unreceived_messages", check("SELECT lead AS uuid FROM ids WHERE mph > 150", "ids"))
def unreceived_messages(spark, sf_dir):
    return audit.unreceived(audit.message_flags(_parsed(spark, sf_dir)))


@query("lost_but_committed", check("SELECT lead AS uuid FROM ids WHERE mph > 150 AND mph <= 180", "ids"))
def lost_but_committed(spark, sf_dir):
    return audit.lost_but_committed(audit.message_flags(_parsed(spark, sf_dir, t.SLOW_COMMITS)))


@query("unqueued_messages", check("SELECT lead AS uuid FROM ids WHERE mph < 2", "ids"))
def unqueued_messages(spark, sf_dir):
    return audit.unqueued(audit.message_flags(_parsed(spark, sf_dir)))


@query("commit_pair_audit", check("""SELECT COUNT(*) AS pairs, MIN(c) AS fewest, MAX(c) AS most,
    COUNT(*) FILTER (c <> 2) AS odd_pairs FROM (SELECT CASE WHEN mph <= 100 THEN 2::BIGINT ELSE 1 END AS c FROM ids)""", "ids"))
def commit_pair_audit(spark, sf_dir):
    return audit.commit_pair_audit(_parsed(spark, sf_dir))


@query("odd_commit_pairs", check("SELECT lead, follow, 1::BIGINT AS commits FROM ids WHERE mph > 100", "ids"))
def odd_commit_pairs(spark, sf_dir):
    return audit.odd_commit_pairs(_parsed(spark, sf_dir))


@query("rounds_per_epoch", check("""SELECT concat(':', strftime(ts, '%S'), 'Z') AS epoch, COUNT(*) AS rounds
    FROM status WHERE color = 'green' GROUP BY 1"""))
def rounds_per_epoch(spark, sf_dir):
    return audit.rounds_per_epoch(_parsed(spark, sf_dir))


@query("message_totals", check("""SELECT COUNT(*) FILTER (color = 'red') AS errors,
    COUNT(*) FILTER (color = 'white') + COUNT(*) FILTER (mph > 300) AS aborts, COUNT(*) AS sent,
    COUNT(*) FILTER (mph <= 150) AS received FROM status"""))
def message_totals(spark, sf_dir):
    return audit.message_totals(_parsed(spark, sf_dir))


@query("message_violations", check("""SELECT 'DEBUG Consensus abort null' AS line, 'abort without message' AS rule
    FROM status WHERE mph > 300"""))
def message_violations(spark, sf_dir):
    return audit.message_violations(_parsed(spark, sf_dir))


@query("singletons", check("SELECT mph FROM status GROUP BY mph HAVING COUNT(*) = 1"))
def singletons(spark, sf_dir):
    return audit.singletons(t.status(spark, sf_dir), "mph")
