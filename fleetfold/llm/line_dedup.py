"""Drops boilerplate lines: those found on too large a share of their host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import broadcast_below, cut_lineage, fresh_name

PERCENT = 5
#: Only what repetition itself needs; the share of pages decides.
MIN_PAGES = 2
BROADCAST_ROWS = 500_000


def drop_boilerplate(docs: DataFrame, host: str = "source", percent: float = PERCENT,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; rows and other columns stay.

    A line is the text between line feeds, compared without blanks around it;
    blank lines always stay. A line is boilerplate on a host when more than
    ``percent`` of the host's pages contain it, and at least ``min_pages`` do: by default
    two, which is repetition itself, so that the share decides on hosts of any size. A
    page is a distinct text of the host, so exact copies of a page count once: they
    are the concern of document deduplication. Near copies are distinct texts and count
    as a page each: a group of them that makes up more than ``percent`` of the host's
    pages loses the lines its members share, in every member, also in the one that a
    later deduplication keeps; a smaller group loses none by itself. ``n_chars``, where there is such a
    column, becomes the new length.

    A null host is a host of its own. Null texts stay null, empty ones empty; a
    text of boilerplate only becomes empty. Repeated rows are treated alike.
    Extra columns pass through, whatever their names; an empty table stays empty.
    """
    marked = boilerplate_positions(docs, host, percent, min_pages)
    h, k1, k2, gone = (fresh_name(docs, c) for c in ("host_key", "text_key1", "text_key2", "gone_lines"))
    keyed = docs.withColumns({h: _host(F.col(host)), **dict(zip((k1, k2), _text_key(F.col("text"))))})
    joined = keyed.join(broadcast_below(marked.toDF(h, k1, k2, gone), BROADCAST_ROWS), [h, k1, k2], "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def boilerplate_positions(docs: DataFrame, host: str = "source", percent: float = PERCENT,
                          min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host and text (by hash) with boilerplate: the numbers of its boilerplate lines, from 0.

    Lines are counted by hash with partial counts, so a line on every page costs a
    row per task; a page's line numbers are never more than its own lines.
    """
    lines = _lines(docs, host)
    on_pages = lines.select("h", "l1", "l2", "t1", "t2").distinct().groupBy("h", "l1", "l2").agg(
        F.count(F.lit(1)).alias("pages"))
    frequent = cut_lineage(on_pages.where(F.col("pages") >= min_pages), "frequent-lines")
    t1, t2 = _text_key(F.col("text"))
    totals = cut_lineage(docs.where("text is not null").select(_host(F.col(host)).alias("h"), t1.alias("t1"), t2.alias("t2"))
                         .distinct().groupBy("h").agg(F.count(F.lit(1)).alias("total")), "host-pages")
    bad = frequent.join(totals, "h").where(100 * F.col("pages") > percent * F.col("total")).select("h", "l1", "l2")
    bad = cut_lineage(bad, "boilerplate")
    found = lines.join(broadcast_below(bad, BROADCAST_ROWS), ["h", "l1", "l2"], "left_semi")
    return cut_lineage(found.groupBy("h", "t1", "t2").agg(F.collect_set("pos").alias("gone")), "boilerplate-lines")


def _host(host: Column) -> Column:
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), host.cast("string")))


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text or a line."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """One row per line that is not blank: host, text and line by hash, and the line's number."""
    t1, t2 = _text_key(F.col("text"))
    whole = docs.select(_host(F.col(host)).alias("h"), t1.alias("t1"), t2.alias("t2"),
                        F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    l1, l2 = _text_key(F.trim("line"))
    return whole.where(F.trim("line") != "").select("h", "t1", "t2", "pos", l1.alias("l1"), l2.alias("l2"))
