"""Exact duplicates by content sort: ranges of normalised texts, sorted, each text compared with its neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.words import ascii_lower, cut_lineage, partitions

#: A group of copies is cut into pieces of at most one partition's mean number of rows over this.
FINENESS = 4
#: Splitters are of so many leading characters, since the sample they come from passes through the driver.
START = 32


def copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; nothing but whole texts is compared to
    decide that. Spark samples splitters of leading characters, deals the normalised texts to ranges and sorts each range, on
    disk where memory ends; texts that begin alike are ordered by hash and then in full. A row begins a group where
    its whole text differs from its neighbour's. Of a group the row with the ``smallest`` (or ``largest``) ``doc_id`` stays.

    A group of so many copies that it would fill a good part of a range is split by ``doc_id``
    into pieces, which are sorted, compared and reduced like groups; then one text of each piece is compared
    with the other pieces'. There are at most ``FINENESS`` such groups per partition, so their table is broadcast.

    A null text is empty. Rows with a null ``doc_id`` take part and stay only where all their group's are null.
    Of rows that repeat both text and ``doc_id`` one stays. Other columns are ignored; an empty table
    gives an empty result.
    """
    return _judged(docs, keep, []).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    return _judged(docs, keep, [whole]).where("kept").select("whole.*")


def _judged(docs: DataFrame, keep: str, carried: list[Column]) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    rows = docs.select("doc_id", ascii_lower(F.col("text")).alias("body"), *carried).withColumn("h", F.xxhash64("body"))
    hot = _hot_groups(rows, docs.count() * 1.0 / (FINENESS * partitions(docs.sparkSession)))
    found = cut_lineage(_sorted(rows, hot, keep), "sorted-texts")

    rank = F.struct(F.col("best").isNull().alias("none"), "best", "piece")
    if keep == "largest":
        rank = F.struct(F.col("best").isNotNull().alias("some"), "best", "piece")
    chosen = (F.min if keep == "smallest" else F.max)(rank).alias("c")
    joined = found.where("head is not null").groupBy("head").agg(F.sum("size").alias("all"), chosen)
    joined = joined.select(F.sha2("head", 256).alias("text_sha256"), "all", F.col("c.best").alias("all_best"),
                           F.col("c.piece").alias("home"))
    out = found.join(F.broadcast(cut_lineage(joined, "split-groups")), "text_sha256", "left")
    split = F.col("all").isNotNull()
    return out.withColumns({
        "keep_id": F.when(split, F.col("all_best")).otherwise(F.col("best")),
        "group_size": F.coalesce("all", "size"),
        "kept": (F.col("place") == 1) & (~split | (F.col("piece") == F.col("home")))})


def _sorted(rows: DataFrame, hot: DataFrame, keep: str) -> DataFrame:
    """Rows by groups of equal texts, or pieces of them, after one exchange to ranges and one sort."""
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(-1)
    rows = rows.join(F.broadcast(hot), "h", "left").withColumns({"piece": piece, "start": F.substring("body", 1, START)})
    ranged = rows.repartitionByRange("start", "h", "piece")
    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    equal = Window.partitionBy("start", "h", "body", "piece").orderBy(first)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.select("*", F.row_number().over(equal).alias("place"), F.first("doc_id").over(whole).alias("best"),
                          F.count(F.lit(1)).over(whole).alias("size"))
    head = F.when((F.col("place") == 1) & (F.col("piece") >= 0), F.col("body"))
    return found.select("doc_id", "best", "size", "place", "piece", F.sha2("body", 256).alias("text_sha256"),
                        head.alias("head"), *[c for c in ("whole",) if c in rows.columns])


def _hot_groups(rows: DataFrame, most: float) -> DataFrame:
    """Hashes of texts with more than ``most`` rows, and into how many pieces to cut them."""
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > most) & (F.col("c") > 1))
    return cut_lineage(counts.select("h", F.ceil(F.col("c") / F.lit(max(most, 1.0))).alias("pieces")), "hot-texts")
