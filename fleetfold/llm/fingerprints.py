"""Classes numbered by the first half of a 128-bit fingerprint, also where two of them share that half."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes that share a first half: some 40 pairs are expected among 4e10 classes.
MOST = 1_000_000


def colliding(pairs: DataFrame) -> dict[tuple[int, int], int]:
    """Other numbers for the fingerprints (``cls``, ``chk``) whose first half belongs to several; the smallest second half keeps it.

    Such a table is small whatever the input, since halves are shared by chance only.
    """
    halves = pairs.groupBy("cls").agg(F.min("chk").alias("least"), F.max("chk").alias("greatest")).where("least <> greatest")
    shared = pairs.join(halves.select("cls", "least"), "cls").where("chk <> least").select("cls", "chk").distinct()
    moved: dict[tuple[int, int], int] = {}
    found = shared.orderBy("cls", "chk").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise RuntimeError("too many classes share half of their fingerprint")
    for turn in range(64):
        left = [r for r in map(tuple, found) if r not in moved]
        if not left:
            return moved
        spark = pairs.sparkSession
        tried = spark.createDataFrame(left, "cls long, chk long").select("*", F.xxhash64("chk", "cls", F.lit(turn)).alias("new"))
        taken = {r[0] for r in tried.join(pairs.select(F.col("cls").alias("new")), "new", "left_semi").select("new").distinct().collect()}
        taken |= set(moved.values())
        for cls, chk, new in tried.orderBy("cls", "chk").collect():
            if new not in taken:
                moved[cls, chk] = new
                taken.add(new)
    raise RuntimeError("no numbers left for classes")


def renamed(df: DataFrame, moved: Mapping[tuple[int, int], int]) -> DataFrame:
    """``df`` with the other numbers in ``cls``."""
    rows = df.sparkSession.createDataFrame([(*k, v) for k, v in moved.items()], "cls long, chk long, new_cls long")
    out = df.join(F.broadcast(rows), ["cls", "chk"], "left").withColumn("cls", F.coalesce("new_cls", "cls"))
    return out.select(*df.columns)
