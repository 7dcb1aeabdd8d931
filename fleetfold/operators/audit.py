"""Convergence and message-reconciliation audits over log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.functions.scalars import percent_error
from fleetfold.operators.scans import exact_median, value_counts
from fleetfold.session import cut_lineage

# The texts by which log lines are told apart, in order of precedence.
LINE_KINDS = (
    ("send", "OutSocketManager trying to send"),
    ("receive", "NetworkLayer message . from: . got"),
    ("commit", "Consensus commit"),
    ("abort", "Consensus abort "),
    ("error", "ERROR"),
    ("start", "start new round"),
    ("queue", "queueing"),
)
SMALL_EPOCH = 100_000
CARRY_IDS = ("send", "receive", "commit", "abort", "queue")
NULL_ABORT = "Consensus abort null"
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ROUND_EPOCH = ":[0-6][0-9]Z"
FINAL_RESULT = "FINAL RESULT:"
AVERAGE_OF_IDS = r"avg, item=ids\]=([0-9.eE+-]+)"
SUM_OF_IDS = r"sum, item=ids\]=([0-9.eE+-]+)"
RESULT_EPOCH = r"EPOCH: (\S+)"


def parse_results(lines: DataFrame) -> DataFrame:
    """Final-result lines (path, line) as (path, epoch, avg, sum); a missing number is null.

    A column ``position``, which orders the lines of a file, is passed on.
    """
    def number(pattern):
        return F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).try_cast("double")

    place = [c for c in lines.columns if c == "position"]
    return lines.where(F.col("line").contains(FINAL_RESULT)).select(
        "path", *place, F.regexp_extract("line", RESULT_EPOCH, 1).alias("epoch"),
        number(AVERAGE_OF_IDS).alias("avg"), number(SUM_OF_IDS).alias("sum"))


def _last_lines(parsed: DataFrame) -> DataFrame:
    """The last line of each file and epoch, where lines have a position."""
    if "position" not in parsed.columns:
        return parsed
    return parsed.groupBy("path", "epoch").agg(
        F.max_by("avg", "position").alias("avg"), F.max_by("sum", "position").alias("sum"))


def averages(parsed: DataFrame) -> DataFrame:
    """(path, epoch, value): the last average each file reports for an epoch."""
    reported = _last_lines(parsed.where(F.col("avg").isNotNull()))
    return reported.select("path", "epoch", F.col("avg").alias("value"))


def results_by_op(parsed: DataFrame) -> DataFrame:
    """(path, epoch, op, value), one row per number on a file's last line for an epoch."""
    pairs = F.array(F.struct(F.lit("avg").alias("op"), F.col("avg").alias("value")),
                    F.struct(F.lit("sum").alias("op"), F.col("sum").alias("value")))
    return _last_lines(parsed).select("path", "epoch", F.inline(pairs)).where(F.col("value").isNotNull())


def head_epochs(values: DataFrame, head_mark: str = "CLUSTERHEAD") -> DataFrame:
    """Results of cluster heads, in epochs that occur among all nodes."""
    heads = values.where(F.col("path").contains(head_mark))
    return heads.join(values.select("epoch").distinct(), "epoch", "left_semi").select("epoch", "value")


def incomplete_epochs(values: DataFrame, nodes: int | None = None) -> DataFrame:
    """Epochs whose number of results differs from the number of nodes."""
    counts = values.groupBy("epoch").agg(F.count("*").alias("members"))
    return counts.where(F.col("members") != (node_count(values) if nodes is None else nodes))


def node_count(logs: DataFrame) -> int:
    """Number of nodes that wrote a log."""
    return logs.agg(F.count_distinct("path")).first()[0]


def epoch_error_stats(values: DataFrame, nodes: int | None = None) -> DataFrame:
    """Spread and error of each epoch's results against the mean of ids 0 .. N-1.

    N is the number of nodes that logged, unless given. Percent errors are null
    for N = 1, where the expected value is 0. Equal values of an epoch are
    counted and the counts written to the shared folder first, so the log is
    parsed once for all eight columns. Medians come from the same aggregation
    when no epoch has more than ``SMALL_EPOCH`` distinct values, and otherwise
    from ``exact_median``, which spreads an epoch over many tasks.
    """
    if nodes is None:
        nodes = node_count(values)
    expected = F.lit((nodes - 1) / 2.0)
    counts = cut_lineage(value_counts(values, ["epoch"], "value"), "epoch-values")
    counts = counts.withColumn("_off", F.col("value") - expected).withColumn(
        "_error", percent_error("value", expected))
    size = F.sum("n")

    def mean_of(column):
        return F.sum(column * F.col("n")) / size

    off = F.col("_off")
    stats = [
        mean_of(F.col("value")).alias("mean"),
        F.greatest(mean_of(off * off) - F.pow(mean_of(off), F.lit(2.0)), F.lit(0.0)).alias("variance"),
        mean_of(F.col("_error")).alias("mean_error"),
        (size * F.lit(100.0) / F.lit(float(nodes))).alias("participation"),
        F.max("_error").alias("max_error")]
    medians = {"median": "value", "median_error": "_error"}
    widest = counts.groupBy("epoch").count().agg(F.max("count")).first()[0] or 0
    if widest <= SMALL_EPOCH:
        stats += [F.percentile(column, 0.5, F.col("n")).alias(name) for name, column in medians.items()]
        done = counts.groupBy("epoch").agg(*stats)
    else:
        done = counts.groupBy("epoch").agg(*stats)
        done, counts = (d.withColumn("_key", F.struct("epoch")) for d in (done, counts))  # a null epoch is an epoch
        for name, column in medians.items():
            done = done.join(exact_median(counts, ["_key"], column, name), "_key", "left")
    return done.select(
        "epoch", "median", "mean", "variance", "mean_error", "participation", "max_error", "median_error")


def convergence_summary(stats: DataFrame, skip: int = 10, length: int = 50) -> DataFrame:
    """Maximum error over ``length`` epochs, from ``skip`` after the first full epoch.

    Only the ``skip + length`` epochs from the first full one on leave their
    tasks, so ordering them needs no global sort of all epochs.
    """
    first = stats.where(F.col("participation") == 100.0).agg(F.min("epoch")).scalar()
    slice_ = (stats.where(F.col("epoch") >= first).select("epoch", "max_error")
              .orderBy("epoch").limit(skip + length))
    numbered = slice_.withColumn("_rn", F.row_number().over(Window.orderBy("epoch")))
    kept = numbered.where(F.col("_rn") > skip)
    return kept.agg(
        F.count("*").alias("epochs"), F.percentile("max_error", 0.5).alias("median"),
        F.avg("max_error").alias("mean"), F.var_pop("max_error").alias("variance"))


def parse_messages(lines: DataFrame) -> DataFrame:
    """Log lines as (line, kind, uuids, epoch); the first matching kind counts, else null.

    Message ids and epochs are searched only in kinds of lines that carry them.
    """
    kind = None
    for name, pattern in LINE_KINDS:
        hit = F.col("line").rlike(pattern) if "." in pattern else F.col("line").contains(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    ids = F.regexp_extract_all("line", F.lit(UUID), F.lit(0))
    epoch = F.nullif(F.regexp_extract("line", ROUND_EPOCH, 0), F.lit(""))
    return lines.withColumn("kind", kind).select(
        "line", "kind", F.when(F.col("kind").isin(*CARRY_IDS), ids).otherwise(F.array()).alias("uuids"),
        F.when(F.col("kind") == "start", epoch).alias("epoch"))


def message_violations(parsed: DataFrame) -> DataFrame:
    """Lines that break the log's own rules, with the rule they break."""
    ids = F.size("uuids")
    rule = (
        F.when(F.col("line").contains(NULL_ABORT), "abort without message")
        .when((F.col("kind") == "commit") & (ids != 2), "commit needs two messages")
        .when((F.col("kind") == "abort") & (ids != 1), "abort needs one message")
        .when(F.col("kind").isin("send", "receive", "queue") & (ids < 1), "message id missing")
        .when((F.col("kind") == "start") & F.col("epoch").isNull(), "round start without epoch")
    )
    return parsed.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("line", "rule")


def message_flags(parsed: DataFrame) -> DataFrame:
    """One row per message id: was it sent, received, queued, committed.

    All reconciliation questions are filters over this one aggregation, which
    collapses repeats before its shuffle.
    """
    ids = F.when(F.col("kind") == "commit", F.col("uuids")).otherwise(F.slice("uuids", 1, 1))
    each = parsed.where(F.col("kind").isin("send", "receive", "queue", "commit")).select(
        "kind", F.explode(ids).alias("uuid"))
    names = {"sent": "send", "received": "receive", "queued": "queue", "committed": "commit"}
    return each.groupBy("uuid").agg(*[
        F.max(F.col("kind") == kind).alias(name) for name, kind in names.items()])


def unreceived(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("sent") & ~F.col("received")).select("uuid")


def lost_but_committed(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("sent") & ~F.col("received") & F.col("committed")).select("uuid")


def unqueued(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("received") & ~F.col("queued")).select("uuid")


def commit_pairs(parsed: DataFrame) -> DataFrame:
    """How often each (lead, follow) pair committed."""
    return parsed.where(F.col("kind") == "commit").groupBy(
        F.get("uuids", F.lit(0)).alias("lead"), F.get("uuids", F.lit(1)).alias("follow")
    ).agg(F.count("*").alias("commits"))


def commit_pair_audit(parsed: DataFrame) -> DataFrame:
    """Number of pairs, fewest and most commits, and pairs not committed exactly twice."""
    return commit_pairs(parsed).agg(
        F.count("*").alias("pairs"), F.min("commits").alias("fewest"), F.max("commits").alias("most"),
        F.count_if(F.col("commits") != 2).alias("odd_pairs"))


def odd_commit_pairs(parsed: DataFrame) -> DataFrame:
    return commit_pairs(parsed).where(F.col("commits") != 2)


def reversed_pairs(parsed: DataFrame) -> DataFrame:
    """Pairs that committed in both directions, which the protocol rules out."""
    pairs = commit_pairs(parsed).where(F.col("lead") != F.col("follow"))
    ends = pairs.groupBy(F.least("lead", "follow").alias("one"), F.greatest("lead", "follow").alias("other"))
    return ends.agg(F.count("*").alias("directions")).where(F.col("directions") > 1)


def rounds_per_epoch(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") == "start").groupBy("epoch").agg(F.count("*").alias("rounds"))


def message_totals(parsed: DataFrame) -> DataFrame:
    names = {"errors": "error", "aborts": "abort", "sent": "send", "received": "receive"}
    return parsed.agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in names.items()])


def singletons(df: DataFrame, column: str) -> DataFrame:
    """Values that occur exactly once."""
    return df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") == 1).select(column)
