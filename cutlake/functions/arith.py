"""Exact integer and guarded floating-point column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def as_col(value: Column | str | int | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def wide(value: Column | str | int) -> Column:
    """38-digit integer, for products that overflow 64 bits."""
    return as_col(value).cast("decimal(19,0)")


def idiv(num: Column | str | int, den: Column | str | int) -> Column:
    """Integer quotient truncated toward zero; NULL on a zero divisor."""
    d = as_col(den)
    return F.when(d != 0, F.call_function("div", as_col(num), d))


def idiv_half_away(num: Column, den: Column) -> Column:
    """Integer quotient rounded half away from zero; NULL on a zero divisor."""
    half = F.call_function("div", den, F.lit(2))
    return F.when(
        den != 0,
        F.call_function("div", F.when(num >= 0, num + half).otherwise(num - half), den),
    )


def grid_floor(value: Column | str, width: int) -> Column:
    """Start of the width-wide cell holding ``value``; correct for negatives."""
    v = as_col(value)
    return v - F.pmod(v, F.lit(width).cast("bigint"))


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` held to [low, high]; NULL stays NULL."""
    held = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), held)


def ratio(num: Column, den: Column) -> Column:
    """num/den as double; NULL where the divisor is zero or either side is NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for comparing across engines."""
    r = F.round(value.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
