"""As-of joins: nearest earlier and later row by time, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.operators.scan import CELL, Scan, chunked_scan


def asof_neighbours(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    point_time: str,
    event_time: str,
    values: Sequence[str],
    *,
    sides: Sequence[str] = ("prev",),
    strict: bool = False,
    cell: int = CELL,
) -> DataFrame:
    """Add ``prev`` and/or ``next``: STRUCT<event_time, values...> of the nearest event.

    ``prev`` is the last event at or before the point, ``next`` the first at or after
    it; ``strict`` excludes an event exactly at the point. Several events at one time
    are reduced to the smallest struct. Unmatched points keep NULL.
    """
    keys = list(keys)
    wanted = points.select(*keys, F.col(point_time).alias("__t"))
    given = events.where(F.col(event_time).isNotNull()).select(
        *keys,
        F.col(event_time).alias("__t"),
        F.struct(F.col(event_time), *[F.col(v) for v in values]).alias("__v"),
    )
    # One row per (key, time), so a cell of the scan is bounded by its width.
    axis = wanted.unionByName(given, allowMissingColumns=True).groupBy(*keys, "__t").agg(F.min("__v").alias("__v"))
    scans = []
    if "prev" in sides:
        scans.append(Scan("prev", "last", F.col("__v"), inclusive=not strict))
    if "next" in sides:
        scans.append(Scan("next", "first", F.col("__v"), inclusive=not strict))
    found = chunked_scan(axis, keys, "__t", scans, cell)
    found = found.select(*keys, F.col("__t").alias(point_time), *[s.name for s in scans])
    return points.join(found, [*keys, point_time], "left")
