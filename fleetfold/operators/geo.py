"""Boxes, regions and geographically scoped queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.session import cut_lineage, small_rows

MAX_CASES = 64
CELL_BOXES = 256
CELL_STEP = 4
SPREAD = 16
MAX_LEVELS = 12
SMALLEST_EXTENT = 1e-6


@dataclass(frozen=True)
class Box:
    """A closed latitude and longitude range."""

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    rid: str = ""


# The two filter boxes and the two region lists of the stock queries.
DENSE_BOX = Box(5000.0, 50500.0, 100000.0, 110000.0)
SPARSE_BOX = Box(40000.0, 51297.0, 106800.0, 114000.0)
DENSE_REGIONS = (
    Box(5000.0, 50500.0, 100000.0, 110000.0, "d1"),
    Box(50500.0, 90500.0, 100000.0, 110000.0, "d2"),
)
SPARSE_REGIONS = (
    Box(40000.0, 51297.0, 106800.0, 114000.0, "s1"),
    Box(51297.0, 65648.5, 106800.0, 114000.0, "s2"),
)

# The open boxes of the stored position views, as x and y limits.
DENSE_VIEW = Box(50000.0, 51000.0, 100000.0, 102000.0)
SPARSE_VIEW = Box(40000.0, 53000.0, 106800.0, 114000.0)


def inside(box: Box, lat: str = "lat", lon: str = "lon", closed: bool = True) -> Column:
    """Containment as plain comparisons, which reach the file scan as filters."""
    y, x = F.col(lat), F.col(lon)
    if closed:
        return y.between(box.lat_min, box.lat_max) & x.between(box.lon_min, box.lon_max)
    return (y > box.lat_min) & (y < box.lat_max) & (x > box.lon_min) & (x < box.lon_max)


def first_region(regions: Sequence[Box], lat: str = "lat", lon: str = "lon") -> Column:
    """Id of the first region in list order that contains the point, else null."""
    choice = None
    for box in regions:
        hit = inside(box, lat, lon)
        choice = F.when(hit, F.lit(box.rid)) if choice is None else choice.when(hit, F.lit(box.rid))
    return F.lit(None).cast("string") if choice is None else choice


def map_regions(df: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``rid``: the region of lowest ``ord`` containing the point, else null.

    ``ord`` must be unique. A few regions become a CASE expression. A longer table is indexed by cell and looked up
    in one join, see ``_cells``, and another names the winner; a row's matches are reduced to the first before anything is shuffled by row. On a stream
    rows cannot be brought together again, so there each level of the index is a join of its own. Either way a row stays one row.
    """
    rows = small_rows(regions, MAX_CASES)
    if rows is not None:
        rows.sort(key=lambda r: r["ord"])
        boxes = [Box(r["lat_min"], r["lat_max"], r["lon_min"], r["lon_max"], r["rid"]) for r in rows]
        return df.withColumn("rid", first_region(boxes, lat, lon))
    boxes = cut_lineage(regions.select("ord", "rid", *(c for pair in PLACE for c in pair)), "regions")

    def first_of(lists: Column) -> Column:
        hits = F.filter(lists, lambda b: F.col(lat).between(b["lat_min"], b["lat_max"]) & F.col(lon).between(b["lon_min"], b["lon_max"]))
        return F.array_min(F.transform(hits, lambda b: b["ord"]))

    index = _cells(boxes, PLACE, ("ord",))
    if not index.sides:
        return df.withColumn("rid", F.lit(None).cast("string"))
    index = _leaders(index)
    at = (F.col(lat), F.col(lon))
    named = boxes.select(F.col("ord").alias("_hit"), "rid")
    if df.isStreaming:
        cells, found, best = cut_lineage(index.table, "cells"), df, []
        for level in range(len(index.sides)):
            table = cells.where(F.col("_level") == level).groupBy("_cell").agg(F.flatten(F.collect_list("_boxes")).alias(f"_boxes{level}"))
            found = found.withColumn("_cell", index.cell(at, level)).join(table, "_cell", "left").drop("_cell")
            best.append(first_of(F.col(f"_boxes{level}")))
        winner = best[0] if len(best) == 1 else F.least(*best)
        return found.withColumn("_hit", winner).join(named, "_hit", "left").select(*df.columns, "rid")

    # Each column by itself, so that those nobody reads are pruned.
    kept = [F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(df.columns)]
    numbered = df.select(*kept, F.monotonically_increasing_id().alias("_row"), at[0].alias("_y"), at[1].alias("_x"))
    lat, lon = "_y", "_x"
    hit = index.look_up(numbered, (F.col("_y"), F.col("_x"))).withColumn("_hit", first_of(F.col("_boxes")))
    out = hit.groupBy("_row").agg(*[F.first(f"_v{i}").alias(f"_v{i}") for i in range(len(kept))], F.min("_hit").alias("_hit"))
    return out.join(named, "_hit", "left").select(*[F.col(f"_v{i}").alias(c) for i, c in enumerate(df.columns)], "rid")


def active_queries(df: DataFrame, specs: DataFrame, lat: str = "lat", lon: str = "lon",
                   time: str = "ts") -> DataFrame:
    """One row per status row and query that applies at its place and time.

    ``specs`` has query_id, the four box limits, from_ts and to_ts (exclusive). A few specs are tested in the scan; more
    are indexed by place and time and looked up in one join, on batch frames and streams.
    """
    def applies(s):
        return (F.col(lat).between(s["lat_min"], s["lat_max"])
                & F.col(lon).between(s["lon_min"], s["lon_max"])
                & (F.col(time) >= s["from_ts"]) & (F.col(time) < s["to_ts"]))

    rows = small_rows(specs, MAX_CASES)
    if rows is not None:
        hits = [F.when(applies({k: F.lit(r[k]) for k in
                                ("lat_min", "lat_max", "lon_min", "lon_max", "from_ts", "to_ts")}),
                       F.lit(r["query_id"])) for r in rows]
        ids = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
        return df.withColumn("query_id", F.explode(ids))

    timed = cut_lineage(specs.withColumns({"_from": _hours("from_ts"), "_to": _hours("to_ts")}).where("from_ts < to_ts"), "specs")
    index = _cells(timed, (*PLACE, ("_from", "_to")), ("query_id", "from_ts", "to_ts"))
    if not index.sides:
        return df.withColumn("query_id", F.explode(F.array().cast("array<string>")))
    found = index.look_up_spread(df, (F.col(lat), F.col(lon), _hours(time)))
    return found.withColumn("_hit", F.explode(F.filter("_boxes", applies))).select(*df.columns, F.col("_hit.query_id").alias("query_id"))


PLACE = (("lat_min", "lat_max"), ("lon_min", "lon_max"))


def _hours(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / F.lit(3.6e9)


@dataclass(frozen=True)
class _Index:
    """Boxes by cell: ``table`` has _level, _cell (coordinates), _part and _boxes; ``sides`` the cell sides of each level."""

    table: DataFrame
    sides: list[tuple[float, ...]]

    def cell(self, at: Sequence[Column], level: int) -> Column:
        return F.array(*[F.floor(x / s) for x, s in zip(at, self.sides[level])])

    def look_up(self, df: DataFrame, at: Sequence[Column], how: str = "left") -> DataFrame:
        """Each row with the lists of boxes in its cell of every level, a row per list, from one join."""
        return self._keyed(df, at).join(self.table, ["_level", "_cell"], how)

    def look_up_spread(self, df: DataFrame, at: Sequence[Column]) -> DataFrame:
        """The rows that have lists, a row per list; each cell's rows are dealt to ``SPREAD`` tasks, and its lists go to each.

        The lists are short, so adaptive execution would take their few bytes for little work; the number of tasks is fixed.
        """
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = ["_level", "_cell", "_spread"]
        dealt = self._keyed(df, at).withColumn("_spread", F.pmod(F.xxhash64(*at), F.lit(SPREAD)).cast("int"))
        lists = self.table.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        return dealt.repartition(tasks, *keys).join(lists, keys)

    def _keyed(self, df: DataFrame, at: Sequence[Column]) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("_level"), self.cell(at, k).alias("_cell")) for k in range(len(self.sides))])
        return df.withColumn("_key", F.explode(keys)).withColumns({c: F.col(f"_key.{c}") for c in ("_level", "_cell")}).drop("_key")


def _cells(boxes: DataFrame, ranges: Sequence[tuple[str, str]], extra: Sequence[str]) -> _Index:
    """Boxes indexed by cells of a hierarchy of grids.

    Per direction a box lies on the grid whose side is the least power of ``CELL_STEP`` not below its extent, so it
    touches at most two cells per direction. A level is a combination of sides that occurs; where more than ``MAX_LEVELS`` do,
    sides are rounded up together until no more are left, at most by a factor common to all directions. So the number of levels is
    bounded whatever the table. A cell with more than ``CELL_BOXES`` boxes has several lists. Boxes without an inside are left out.
    ``boxes`` is a stored table, since it is read several times.
    """
    step, d = F.log2(F.lit(float(CELL_STEP))), len(ranges)
    possible = reduce(lambda a, b: a & b, [F.col(low) <= F.col(high) for low, high in ranges])
    power = [F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(SMALLEST_EXTENT))) / step).cast("int") for low, high in ranges]
    fields = dict.fromkeys([*(c for pair in PLACE for c in pair), *extra])
    names, bounds = [f"_p{k}" for k in range(d)], dict.fromkeys(c for pair in ranges for c in pair)
    placed = boxes.where(possible).select(*dict.fromkeys([*fields, *bounds]), *[p.alias(n) for n, p in zip(names, power)])
    levels = sorted(tuple(r) for r in placed.select(*names).distinct().collect())
    if not levels:
        return _Index(placed, [])
    if len(levels) > MAX_LEVELS:
        # One number says how far a box is above the finest grid, in the direction where it is most.
        least = [min(level[k] for level in levels) for k in range(d)]
        stride = -(-(max(max(p - q for p, q in zip(level, least)) for level in levels) + 1) // MAX_LEVELS)
        above = F.ceil(F.greatest(*[F.col(n) - F.lit(q) for n, q in zip(names, least)]) / F.lit(stride)) * stride
        placed = placed.withColumn("_above", above.cast("int")).withColumns({n: F.col("_above") + F.lit(q) for n, q in zip(names, least)})
        ups = {-(-max(p - q for p, q in zip(level, least)) // stride) * stride for level in levels}
        levels = [tuple(q + up for q in least) for up in sorted(ups)]
    level = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.col(n) == p for n, p in zip(names, combination)]), k)
                         for k, combination in enumerate(levels)])
    for k, (low, high) in enumerate(ranges):
        side = F.pow(F.lit(float(CELL_STEP)), F.col(names[k]))
        placed = placed.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))))
    placed = placed.select(level.alias("_level"), F.array(*[F.col(f"_c{k}") for k in range(d)]).alias("_cell"), *fields)
    table = _listed(placed, list(fields), extra[0])
    return _Index(table, [tuple(float(CELL_STEP) ** p for p in level) for level in levels])


def _listed(placed: DataFrame, fields: Sequence[str], spread: str) -> DataFrame:
    """Boxes of each cell in lists of about ``CELL_BOXES``."""
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("_level", "_cell")) / CELL_BOXES)
    parted = placed.withColumn("_lists", lists).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_lists")))
    return parted.groupBy("_level", "_cell", "_part").agg(F.collect_list(F.struct(*fields)).alias("_boxes"))


def _leaders(index: _Index) -> _Index:
    """The index without boxes that can never be first: those which, inside their cell, lie in one box of lower ``ord``.

    Where many boxes overlap few are left, so a point is not tested against them all. Lists are thinned by themselves, then
    dealt anew and thinned again while that halves the boxes of cells with several lists.
    """
    table, before = index.table, None
    while True:
        table = cut_lineage(table.withColumn("_boxes", _uncovered(index.sides)), "leaders")
        cells = table.groupBy("_level", "_cell").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("_boxes")).alias("boxes"))
        crowded = cells.where("lists > 1").agg(F.sum("boxes")).first()[0] or 0
        if not crowded or before is not None and 2 * crowded > before:
            return _Index(table, index.sides)
        before = crowded
        boxes = table.select("_level", "_cell", F.explode("_boxes").alias("_box")).select("_level", "_cell", "_box.*")
        table = _listed(boxes, boxes.columns[2:], "ord")


def _uncovered(sides: Sequence[tuple[float, ...]]) -> Column:
    sizes = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in sides]), F.col("_level") + 1)

    def covers(a: Column, b: Column) -> Column:
        hits = []
        for k, (low, high) in enumerate(PLACE):
            start, end = F.col("_cell")[k] * sizes[k], (F.col("_cell")[k] + 1) * sizes[k]
            hits += [a[low] <= F.greatest(b[low], start), a[high] >= F.least(b[high], end)]
        return reduce(lambda x, y: x & y, hits)

    ordered = F.sort_array(F.transform("_boxes", lambda b: F.struct(b["ord"].alias("ord"), *[b[c].alias(c) for pair in PLACE for c in pair])))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(
        F.exists(kept, lambda a: covers(a, b)), kept).otherwise(F.concat(kept, F.array(b))))
