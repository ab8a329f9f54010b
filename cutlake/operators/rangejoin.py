"""Range joins as bucketed equi-joins.

Spark plans a bare ``lo <= t AND t < hi`` as a nested-loop join. Cutting the time
axis into buckets turns it into a hash/merge join on (keys, bucket) plus a residual
filter, which adaptive execution can split when a bucket is hot.

Every interval lies on the grid of its own length class. Class 0 has buckets of ``width``
ticks and intervals of up to 8 of them; beyond, class g has buckets of ``8 * width * 4**g``
and intervals that long at most, so they touch two, however long they are. A point is looked up on the grids of the classes that occur, which a
scalar subquery of the same query finds; an interval that meets intervals is copied to
its own grid and the coarser ones of the other side. ``long_width`` asks for two grids
of given widths instead: intervals over 64 buckets lie on the coarser one.

Spark does not see that a side grows where it is dealt to buckets, nor where the caller exploded it,
and would broadcast a side of any size. Both joins therefore ask for a merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import grid_floor

WIDTH = 1 << 19  # ticks; about 5.8 s at 90 kHz
_LONG = 64


def _buckets(lo: Column, hi: Column, width: int) -> Column:
    """All buckets the half-open [lo, hi) touches."""
    return F.sequence(grid_floor(lo, width), grid_floor(hi - 1, width), F.lit(width).cast("bigint"))


def _class(lo: Column, hi: Column, width: int) -> Column:
    """Length class of [lo, hi)."""
    top = (59 - width.bit_length()) // 2
    steps = F.ceil(F.log2((hi - lo) / F.lit(width)) / 2 - 1.5)
    return F.least(F.greatest(steps, F.lit(0)), F.lit(top)).cast("int")


def _cell(value: Column, level: Column, width: int) -> Column:
    """Start of the bucket of a class that holds ``value``."""
    return value - F.pmod(value, _size(level, width))


def _size(level: Column, width: int) -> Column:
    return F.call_function("shiftleft", F.lit(width).cast("bigint"), F.when(level > 0, 2 * level + 3).otherwise(0))


def _cells(lo: Column, hi: Column, level: Column, width: int) -> Column:
    return F.sequence(_cell(lo, level, width), _cell(hi - 1, level, width), _size(level, width))


def _classes(df: DataFrame, lo: str, hi: str, width: int) -> Column:
    """The length classes that occur in a table: 30 at most."""
    spans = df.where(F.col(lo) < F.col(hi))
    return spans.select(F.collect_set(_class(F.col(lo), F.col(hi), width))).scalar()


def _two_grids(df: DataFrame, lo: Column, hi: Column, width: int, long_width: int) -> DataFrame:
    is_long = (hi - lo) > F.lit(_LONG * width)
    return df.where(lo < hi).withColumn("__g", is_long).withColumn(
        "__b", F.explode(F.when(is_long, _buckets(lo, hi, long_width)).otherwise(_buckets(lo, hi, width)))
    )


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str,
    lo: str,
    hi: str,
    *,
    width: int = WIDTH,
    long_width: int | None = None,
) -> DataFrame:
    """Every (point, interval) with equal keys and ``lo <= t < hi``, each pair once.

    Apart from the keys the two sides must not share column names.
    """
    keys = list(keys)
    at = F.col(t)
    if long_width is None:
        # Empty spans and those with a missing end touch nothing.
        right = intervals.where(F.col(lo) < F.col(hi)).withColumn("__g", _class(F.col(lo), F.col(hi), width))
        right = right.withColumn("__b", F.explode(_cells(F.col(lo), F.col(hi), F.col("__g"), width)))
        points = points.withColumn("__classes", _classes(intervals, lo, hi, width))
        places = F.transform("__classes", lambda g: F.struct(g.alias("__g"), _cell(at, g, width).alias("__b")))
    else:
        right = _two_grids(intervals, F.col(lo), F.col(hi), width, long_width)
        places = F.array(
            F.struct(F.lit(False).alias("__g"), grid_floor(t, width).alias("__b")), F.struct(F.lit(True).alias("__g"), grid_floor(t, long_width).alias("__b"))
        )
    left = points.select("*", F.inline(places)).drop("__classes")
    on = [*keys, "__g", "__b"]
    hit = (F.col(lo) <= F.col(t)) & (F.col(t) < F.col(hi))
    return left.hint("merge").join(right, on).where(hit).drop("__b", "__g")


def overlapping_intervals(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    *,
    width: int = WIDTH,
) -> DataFrame:
    """Every (a, b) with equal keys whose half-open spans overlap, each pair once.

    A pair meets on the grid of the longer one and is kept in the bucket of the later start.
    """
    keys = list(keys)
    (a_lo, a_hi), (b_lo, b_hi) = a_span, b_span

    def placed(df: DataFrame, lo: str, hi: str, own: str, other: Column) -> DataFrame:
        span = df.where(F.col(lo) < F.col(hi)).withColumns({own: _class(F.col(lo), F.col(hi), width), "__classes": other})
        grids = F.array_distinct(F.transform("__classes", lambda g: F.greatest(g, F.col(own))))
        cells = F.flatten(F.transform(grids, lambda g: F.transform(_cells(F.col(lo), F.col(hi), g, width), lambda c: F.struct(g.alias("__g"), c.alias("__b")))))
        return span.select("*", F.inline(cells)).drop("__classes")

    left = placed(a, a_lo, a_hi, "__ga", _classes(b, b_lo, b_hi, width))
    right = placed(b, b_lo, b_hi, "__gb", _classes(a, a_lo, a_hi, width))
    hit = (
        (F.col(a_lo) < F.col(b_hi))
        & (F.col(b_lo) < F.col(a_hi))
        & (F.col("__g") == F.greatest("__ga", "__gb"))
        & (_cell(F.greatest(a_lo, b_lo), F.col("__g"), width) == F.col("__b"))
    )
    return left.hint("merge").join(right, [*keys, "__g", "__b"]).where(hit).drop("__g", "__b", "__ga", "__gb")
