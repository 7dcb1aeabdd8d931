"""Shards of near equal bytes from the leaves of a k-d tree over document metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.words import cut_lineage

SHARDS = 8
LEAVES_PER_SHARD = 32
BINS = 256
#: The bin that holds a cell's median is binned again while it has more than such a part of the cell's bytes.
FINE = 32
DIMENSIONS = ("doc_id", "lang", "source", "size")
ROWS_PER_SLOT_GROUP = 20_000


@dataclass
class Tree:
    """Nodes by number; a leaf has dimension -1. Values up to the cut go left. Its size follows from the number of leaves."""
    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def split(self, node: int, dim: int, cut: float) -> None:
        self.dim[node], self.cut[node] = dim, cut
        self.left[node], self.right[node] = len(self.dim), len(self.dim) + 1
        for _ in range(2):
            for column, value in ((self.dim, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0)):
                column.append(value)

    def leaf(self, x: Column) -> Column:
        """The leaf of a point, given as an array of its coordinates."""
        if not self.depth:
            return F.lit(0)
        dim, left, right, cut = map(_listed, (self.dim, self.left, self.right, self.cut))

        def down(node: Column, _: Column) -> Column:
            below = F.when(F.get(x, F.get(dim, node)) <= F.get(cut, node), F.get(left, node)).otherwise(F.get(right, node))
            return F.when(F.get(dim, node) < 0, node).otherwise(below)

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), down)


def assign(docs: DataFrame, shards: int = SHARDS, leaves_per_shard: int = LEAVES_PER_SHARD) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the bytes of the text in UTF-8 plus one. Cells of (``doc_id``,
    ``lang``, ``source``, ``size``) are split along their widest dimension near the median
    by bytes (within a 32nd of the cell, or at a value that itself has more) until a leaf has at most a ``leaves_per_shard``-th of a shard; the leaves,
    largest first, go to the shard with the fewest bytes. The law is ``bytes``: sizes are near equal.
    ``slot`` numbers a shard's documents from 0 without gaps; ``grown_shard`` is null.

    Documents with equal texts are one point and share a shard, unless together they
    exceed a shard's share of the bytes: such a group is dealt out by ``doc_id``.
    A null text counts as an empty one; null metadata are a value of their own. Missing
    ``lang`` or ``source`` columns count as null. Rows may repeat, each gets a slot;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(_rows(docs), "sized")
    totals = rows.agg(F.sum("size"), F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    total, count = totals[0] or 0, totals[1]
    share = max(1, total // shards)
    heavy = (rows.groupBy("g1", "g2").agg(F.sum("size").alias("w")).where(F.col("w") > share)).collect()  # fewer than shards
    part = F.lit(0)
    for group in heavy:
        pieces = int(group.w // max(1, share // leaves_per_shard)) + 1
        part = F.when((F.col("g1") == group.g1) & (F.col("g2") == group.g2),
                      F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")).otherwise(part)
    rows = rows.withColumn("part", part)
    points = _points(rows, totals[2], totals[3], totals[4])
    tree, weights = _grow(points, max(1, share // leaves_per_shard))
    shard_of = [0] * len(tree.dim)
    filled = [0] * shards
    for leaf in sorted(weights, key=lambda n: (-weights[n], n)):
        shard_of[leaf] = min(range(shards), key=lambda s: (filled[s], s))
        filled[shard_of[leaf]] += weights[leaf]
    placed = points.select("g1", "g2", "part", F.get(_listed(shard_of), tree.leaf(F.col("x"))).alias("shard"))
    placed = cut_lineage(placed, "points-placed")
    return _slots(rows.join(placed, ["g1", "g2", "part"]), count, shards)


def _listed(values: list[int] | list[float]) -> Column:
    """A constant array, parsed in one go."""
    return F.expr("array(" + ", ".join(f"{v!r}D" if isinstance(v, float) else str(v) for v in values) + ")")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *meta, (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))


def _points(rows: DataFrame, low: int | None, high: int | None, largest: int | None) -> DataFrame:
    """Groups of equal texts with their bytes and coordinates between 0 and 1."""
    grouped = rows.groupBy("g1", "g2", "part").agg(
        F.sum("size").alias("w"), F.min("size").alias("size"), F.min("doc_id").alias("doc_id"),
        F.min("lang").alias("lang"), F.min("source").alias("source"))
    named = [F.coalesce(F.crc32(F.col(c).cast("binary")) / F.lit(float(2**32)), F.lit(0.0)) for c in ("lang", "source")]
    number = F.coalesce((F.col("doc_id") - F.lit(low or 0)) / F.lit(float(max(1, (high or 0) - (low or 0)))), F.lit(0.0))
    size = F.log("size") / F.greatest(F.lit(1.0), F.log(F.lit(float(largest or 1))))
    return cut_lineage(grouped.select("g1", "g2", "part", "w", F.array(number, *named, size).alias("x")), "points")


def _grow(points: DataFrame, target: int) -> tuple[Tree, dict[int, int]]:
    """The tree, and the bytes of its leaves; each level is an aggregation over all open cells and some over their medians' bins.

    A split leaves points on both sides, so this ends with leaves that are small enough or whose points are all alike.
    """
    tree, weights, grown = Tree(), {}, 0
    dims = range(len(DIMENSIONS))
    while True:
        celled = points.select("w", "x", tree.leaf(F.col("x")).alias("cell"))
        open_cells = celled.where(F.col("cell") >= grown)
        grown = len(tree.dim)
        bounds = open_cells.groupBy("cell").agg(
            F.sum("w").alias("w"), F.array(*[F.min(F.get("x", F.lit(d))) for d in dims]).alias("lo"),
            F.array(*[F.max(F.get("x", F.lit(d))) for d in dims]).alias("hi")).collect()
        wide = {}
        for b in bounds:
            weights[b.cell] = b.w
            d = max(dims, key=lambda k: b.hi[k] - b.lo[k])
            if b.w > target and b.hi[d] > b.lo[d]:
                wide[b.cell] = (d, b.lo[d], b.hi[d])
        if not wide:
            break
        cuts = _medians(open_cells, wide, {c: weights[c] for c in wide})
        for cell, (d, _, _) in wide.items():
            del weights[cell]
            tree.split(cell, d, cuts[cell])
        tree.depth += 1
    return tree, weights


def _medians(cells: DataFrame, wide: dict[int, tuple[int, float, float]], weights: dict[int, int]) -> dict[int, float]:
    """Per cell the value nearest to half its bytes along its dimension, with something above it."""
    best = {c: (float("inf"), lo) for c, (_, lo, _) in wide.items()}
    ranges = {c: (d, lo, hi, 0) for c, (d, lo, hi) in wide.items()}
    while ranges:
        size = max(ranges) + 1
        dim, lo, hi = ([ranges[c][k] if c in ranges else (-1, 0.0, 1.0)[k] for c in range(size)] for k in range(3))
        at = lambda values: F.get(_listed(values), F.col("cell"))
        inside = cells.where(at(dim) >= 0).select("cell", "w", F.get("x", at(dim)).alias("v"), at(lo).alias("lo"), at(hi).alias("hi"))
        inside = inside.where("v between lo and hi")
        bins = inside.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
        counted: dict[int, list] = {c: [] for c in ranges}
        for r in bins.groupBy("cell", "bin").agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("top")).collect():
            counted[r.cell].append((r.bin, r.w, r.low, r.top))
        finer = {}
        for cell, (d, _, _, below) in ranges.items():
            half, top = weights[cell] / 2, wide[cell][2]
            for _, w, low, end in sorted(counted[cell]):
                if below < half <= below + w and w * FINE > weights[cell] and low < end:
                    finer[cell] = (d, low, end, below)
                below += w
                if end < top:
                    best[cell] = min(best[cell], (abs(below - half), end))
        ranges = finer
    return {c: cut for c, (_, cut) in best.items()}


def _slots(placed: DataFrame, count: int, shards: int) -> DataFrame:
    """Numbers each shard's rows by groups that fit a task: offsets of the groups, then places in them."""
    from pyspark.sql import Window

    groups = max(64, count // shards // ROWS_PER_SLOT_GROUP)
    rows = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "g1", "part"), F.lit(groups)).alias("group"))
    counts = rows.groupBy("shard", "group").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("shard", "group", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")), "offsets")
    place = F.row_number().over(Window.partitionBy("shard", "group").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(offsets, ["shard", "group"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
