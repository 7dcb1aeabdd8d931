"""Stock queries by name. Status columns are those of ``schema.STATUS`` with ``node`` for the id."""

from __future__ import annotations

from collections.abc import Sequence

from fleetfold.operators.geo import DENSE_BOX, DENSE_REGIONS, SPARSE_BOX, SPARSE_REGIONS, Box
from fleetfold.plans.spec import MapReduceQuery


def _within(box: Box) -> str:
    return (f"lat BETWEEN {box.lat_min}D AND {box.lat_max}D "
            f"AND lon BETWEEN {box.lon_min}D AND {box.lon_max}D")


def _region_key(regions: Sequence[Box]) -> str:
    return "CASE " + " ".join(f"WHEN {_within(b)} THEN '{b.rid}'" for b in regions) + " END"


def _any(regions: Sequence[Box]) -> str:
    return " OR ".join(f"({_within(b)})" for b in regions)


_QUERIES = (
    MapReduceQuery("speed_and_count", "'speedAndCount'", "mph", "average"),
    MapReduceQuery("speed_sum", "'allNodes'", "mph", "sum"),
    MapReduceQuery("dual_speed", "concat('getSpeed-', node)", "mph", "sum"),
    MapReduceQuery("dual_colors", "concat('getColor-', node)", "color", "union"),
    MapReduceQuery("send_all", "node", "struct(*)", "first", order=("ts", "event_id")),
    MapReduceQuery("speed_by_color", "color", "mph", "sum"),
    MapReduceQuery("geo_filtered_dense", "'dense'", "mph", "average", _within(DENSE_BOX)),
    MapReduceQuery("geo_filtered_sparse", "'sparse'", "mph", "average", _within(SPARSE_BOX)),
    MapReduceQuery("geo_mapped_dense", _region_key(DENSE_REGIONS), "mph", "average",
                   _any(DENSE_REGIONS)),
    MapReduceQuery("geo_mapped_sparse", _region_key(SPARSE_REGIONS), "mph", "average",
                   _any(SPARSE_REGIONS)),
    MapReduceQuery("pos_and_accel", "'posAndAccel'", "struct(mph, acceleration)"),
)
_BY_NAME = {q.id: q for q in _QUERIES}
if len(_BY_NAME) != len(_QUERIES):
    raise ValueError("query ids must be unique")


def query_names() -> list[str]:
    return list(_BY_NAME)


def named_query(name: str) -> MapReduceQuery:
    if name not in _BY_NAME:
        raise KeyError(f"unknown query {name!r}")
    return _BY_NAME[name]
