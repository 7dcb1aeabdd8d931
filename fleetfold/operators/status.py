"""Building typed status rows from textual maps and from single readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfold.functions.scalars import known_colour, triple
from fleetfold.schema import STATUS_KEYS


NUMBERS = tuple(k for k, kind in STATUS_KEYS.items() if kind == "double")


def status_from_map(df: DataFrame, column: str = "fields") -> tuple[DataFrame, DataFrame]:
    """Typed status rows, and the rows that could not be read with the first bad field.

    All ten fields are required; a missing one, a bad number, an unknown colour
    or an acceleration without exactly three parts rejects the row. All numbers
    of a row are converted in one array, which keeps the generated code small;
    which field was bad is worked out for rejected rows only.
    """
    rest = [c for c in df.columns if c != column]
    texts = F.concat(F.array(*[_text(column, k) for k in NUMBERS]), F.split(_text(column, "acceleration"), ","))
    judged = df.withColumns({
        "_id": _text(column, "id").try_cast("bigint"), "_color": _text(column, "color"),
        "_numbers": texts.try_cast("array<double>")})
    whole = (F.size("_numbers") == len(NUMBERS) + 3) & F.col("_id").isNotNull() & known_colour("_color")
    for i in range(len(NUMBERS) + 3):
        whole = whole & F.get("_numbers", F.lit(i)).isNotNull()
    whole = F.coalesce(whole, F.lit(False))

    typed = {k: F.get("_numbers", F.lit(i)) for i, k in enumerate(NUMBERS)}
    axes = [F.get("_numbers", F.lit(len(NUMBERS) + i)).alias(axis) for i, axis in enumerate("xyz")]
    typed |= {"id": F.col("_id"), "color": F.col("_color"), "acceleration": F.struct(*axes)}
    row = F.struct(*[typed[k].alias(k) for k in STATUS_KEYS])
    # As a generator the test stays above the conversion; as a filter it would be
    # pushed below it and convert every number once more per mention.
    good = judged.select(*rest, F.inline(F.when(whole, F.array(row))))
    rejected = judged.select(*df.columns, F.inline(F.when(~whole, F.array(F.struct(F.lit(True).alias("_bad"))))))
    bad = F.coalesce(*[F.when(_field(column, k, kind).isNull(), F.lit(k)) for k, kind in STATUS_KEYS.items()])
    rejects = rejected.select(*df.columns, bad.alias("bad_field"))
    return good, rejects


def _text(column: str, key: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(key))


def _field(column: str, key: str, kind: str) -> Column:
    text = _text(column, key)
    if key == "acceleration":
        return triple(text)
    if key == "color":
        return F.when(known_colour(text), text)
    return text.try_cast(kind)


def assemble_status(readings: DataFrame, types: Sequence[str], keys: Sequence[str] = ("node", "ts"),
                    kind: str = "type", value: str = "reading", order: str = "seq",
                    ) -> tuple[DataFrame, DataFrame]:
    """Long readings to wide rows, taking the last reading of each type.

    Types not asked for are ignored. A row lacking a type is returned in the
    second frame. One aggregation with map-side combine, no pivot stage.
    """
    wanted = readings.where(F.col(kind).isin(*types))
    wide = wanted.groupBy(*keys).agg(*[
        F.max_by(value, F.when(F.col(kind) == t, F.col(order))).alias(t) for t in types])
    lacking = F.lit(False)
    for t in types:
        lacking = lacking | F.col(t).isNull()
    return wide.where(~lacking), wide.where(lacking)


def positions_as_status(positions: DataFrame) -> DataFrame:
    """Stored positions as status rows: x is latitude, y is longitude."""
    return positions.select(
        "node", "timestamp", F.col("x").alias("lat"), F.col("y").alias("lon"), F.col("speed").alias("mph"))
