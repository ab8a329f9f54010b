"""Set operations on rows and on intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.operators.rangejoin import WIDTH, overlapping_intervals
from cutlake.operators.scan import Scan, chunked_scan


def outlier_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both outlier sets."""
    return a.intersect(b)


def interval_union(intervals: DataFrame, keys: Sequence[str], lo: str = "pts_in", hi: str = "pts_out"):
    """Merged intervals per key; touching ones become one."""
    keys = list(keys)
    starts = intervals.where(F.col(lo) < F.col(hi)).groupBy(*keys, lo).agg(F.max(hi).alias("__end"))
    reached = chunked_scan(starts, keys, lo, [Scan("__reach", "max", F.col("__end"), inclusive=False)])
    # An island ends where everything before the next island's start had ended.
    heads = reached.where(F.col("__reach").isNull() | (F.col(lo) > F.col("__reach")))
    heads = chunked_scan(heads, keys, lo, [Scan("__next", "first", F.col("__reach"), inclusive=False)])
    ends = starts.groupBy(*keys).agg(F.max("__end").alias("__last"))
    return heads.join(ends, keys).select(*keys, lo, F.coalesce("__next", "__last").alias(hi))


def remainders(
    rows: DataFrame, cuts: DataFrame, row_key: Sequence[str], lo: str = "pts_in", hi: str = "pts_out"
) -> DataFrame:
    """Parts of each row's interval not covered by its own ``cuts(row_key, cut_lo, cut_hi)``.

    Adds ``piece_in`` and ``piece_out``; rows without cuts come back whole, fully
    covered rows not at all.
    """
    key = list(row_key)
    edges = cuts.groupBy(*key, "cut_lo").agg(F.max("cut_hi").alias("cut_hi"))
    reached = chunked_scan(edges, key, "cut_lo", [Scan("reach", "max", F.col("cut_hi"), inclusive=False)])
    before = reached.select(*key, F.col("reach").alias("from"), F.col("cut_lo").alias("to"))
    after = edges.groupBy(*key).agg(F.max("cut_hi").alias("from")).withColumn("to", F.lit(None).cast("bigint"))
    spans = before.unionByName(after)
    pieces = rows.join(spans, key, "left").withColumns(
        {
            "piece_in": F.greatest(F.col(lo), F.col("from")),
            "piece_out": F.least(F.col(hi), F.col("to")),
        }
    )
    return pieces.where("piece_in < piece_out").drop("from", "to")


def interval_subtract(
    a: DataFrame, b: DataFrame, keys: Sequence[str], row_key: Sequence[str], width: int = WIDTH
) -> DataFrame:
    """What is left of each interval of ``a`` once all of ``b`` on the same keys is cut out."""
    keys, row_key = list(keys), list(row_key)
    knives = b.select(*keys, F.col("pts_in").alias("cut_lo"), F.col("pts_out").alias("cut_hi"))
    wanted = a.select(*dict.fromkeys([*keys, *row_key]), "pts_in", "pts_out")
    hits = overlapping_intervals(
        wanted, knives, keys, ("pts_in", "pts_out"), ("cut_lo", "cut_hi"), width=width
    )
    return remainders(a, hits.select(*row_key, "cut_lo", "cut_hi"), row_key)


def missing_frames(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames of ``a`` that ``b`` lacks."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def unknown_sources(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Source ids that clips use but their project has not registered."""
    key = ["project_id", "source_id"]
    return clips.select(*key).distinct().join(sources.select(*key), key, "left_anti")


def diff_projects(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two versions of a table."""
    keys = list(keys)
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*fields).alias("old"), F.lit(True).alias("__o"))
    n = new.select(*keys, F.struct(*fields).alias("new"), F.lit(True).alias("__n"))
    change = (
        F.when(F.col("__o").isNull(), "added")
        .when(F.col("__n").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    out = o.join(n, keys, "full").withColumn("change", change)
    return out.where(F.col("change").isNotNull()).drop("__o", "__n")
