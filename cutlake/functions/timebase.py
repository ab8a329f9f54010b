"""Column expressions for exact media time: ticks, frames, rates, speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlake.functions.arith import WIDE, as_col, idiv, idiv_half_away, wide

TICKS_PER_SECOND = 90_000
NS_PER_SECOND = 1_000_000_000

Factor = Column | int
_SMALL = 1 << 31
_ROOM = 1 << 62


def _muldiv(x: Column, up: Sequence[Factor], down: Sequence[Factor], half_away: bool = False) -> Column:
    """``x`` times up to two factors over up to two divisors, exact; NULL on a zero divisor.

    64-bit arithmetic where the product provably fits, 38-digit decimals elsewhere.
    """
    divide = idiv_half_away if half_away else idiv

    def product(factors: Sequence[Factor], cast) -> Column:
        out = cast(factors[0])
        for f in factors[1:]:
            out = out * cast(f)
        return out

    def long(f: Factor) -> Column:
        return as_col(f).cast("bigint")

    k, d = product(up, long), product(down, long)
    slow = divide((wide(x) * product(up, wide)).cast(WIDE), product(down, wide).cast(WIDE))
    fits = F.abs(x) <= F.coalesce(idiv(F.lit(_ROOM), F.abs(k)), F.lit(_ROOM))
    fast = F.when(fits, divide(x.cast("bigint") * k, d)).otherwise(slow)
    small = F.lit(True)
    for f in (*up, *down):
        if isinstance(f, Column):
            small = small & (F.abs(f) < _SMALL)
    return F.when(small, fast).otherwise(slow)


def rescale_ticks(pts: Column, src_num: Column, src_den: Column, dst_num: Column, dst_den: Column):
    """Ticks of one timebase in another, truncated; NULL on a zero divisor."""
    return _muldiv(pts, (src_num, dst_den), (src_den, dst_num))


def ticks_to_ns(pts: Column, den: Factor = TICKS_PER_SECOND) -> Column:
    return _muldiv(pts, (NS_PER_SECOND,), (den,))


def ns_to_ticks(ns: Column, den: Factor = TICKS_PER_SECOND) -> Column:
    return _muldiv(ns, (den,), (NS_PER_SECOND,))


def frame_start(frame: Column, num: Column, den: Column, tb: int = TICKS_PER_SECOND) -> Column:
    """Tick of a frame, rounded half away from zero; NULL for a zero rate."""
    return _muldiv(frame, (den, tb), (num,), half_away=True)


def frame_start_trunc(frame: Column, num: Column, den: Column, tb: int = TICKS_PER_SECOND) -> Column:
    return _muldiv(frame, (den, tb), (num,))


def frame_at(pts: Column, num: Column, den: Column, tb: int = TICKS_PER_SECOND) -> Column:
    """Frame nearest a tick, half away from zero; NULL for a zero rate."""
    return _muldiv(pts, (num,), (den, tb), half_away=True)


def frame_at_trunc(pts: Column, num: Column, den: Column, tb: int = TICKS_PER_SECOND) -> Column:
    return _muldiv(pts, (num,), (den, tb))


def frame_count(pts_in: Column, pts_out: Column, num: Column, den: Column, tb: int = TICKS_PER_SECOND):
    """Frames needed to cover [pts_in, pts_out): a ceiling."""
    per = (wide(den) * wide(tb)).cast(WIDE)
    return idiv(((wide(pts_out) - wide(pts_in)) * wide(num) + per - 1).cast(WIDE), per)


def speed_units(speed: Column) -> Column:
    """Speed as an integer number of ten-thousandths, half away from zero."""
    return F.round(speed * F.lit(10000.0)).cast("bigint")


def source_offset(offset: Column, speed: Column) -> Column:
    """Source ticks covered by ``offset`` timeline ticks at a speed."""
    return idiv_half_away(offset * speed_units(speed), F.lit(10000).cast("bigint"))


def timeline_offset(source_delta: Column, speed: Column) -> Column:
    """Timeline ticks covered by source ticks; a speed of zero passes them through."""
    u = speed_units(speed)
    return F.coalesce(idiv_half_away((wide(source_delta) * 10000).cast(WIDE), wide(u)), source_delta)
