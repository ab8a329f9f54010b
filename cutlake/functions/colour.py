"""Column expressions for colour: transfer curves, matrices, tone curves, blending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlake.functions.arith import clamp

RGB = tuple[Column, Column, Column]

# SMPTE ST 2084.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
# ARIB STD-B67.
HLG_A = 0.17883277
HLG_B = 1 - 4 * HLG_A
HLG_C = 0.5599107
# BT.709 luma weights.
LUMA = (0.2126, 0.7152, 0.0722)
# Primaries conversion, row by row.
TO_709 = (
    (1.660491, -0.5876411, -0.0728499),
    (-0.1245505, 1.1328999, -0.0083494),
    (-0.0181508, -0.1005789, 1.1187297),
)
TO_2020 = (
    (0.627404, 0.329282, 0.0433136),
    (0.0690970, 0.91954, 0.0113612),
    (0.0163916, 0.0880132, 0.895595),
)


def pq_to_nits(n: Column) -> Column:
    p = F.pow(F.greatest(n, F.lit(0.0)), F.lit(1 / PQ_M2))
    den = F.lit(PQ_C2) - F.lit(PQ_C3) * p
    ratio = F.greatest(p - PQ_C1, F.lit(0.0)) / F.when(den > 0, den)
    return F.when(n <= 0, 0.0).when(den <= 0, 10000.0).otherwise(F.pow(ratio, F.lit(1 / PQ_M1)) * 10000.0)


def nits_to_pq(nits: Column) -> Column:
    y = F.pow(clamp(nits / 10000.0, 0, 1), F.lit(PQ_M1))
    return F.when(nits <= 0, 0.0).otherwise(
        F.pow((F.lit(PQ_C1) + F.lit(PQ_C2) * y) / (F.lit(1.0) + F.lit(PQ_C3) * y), F.lit(PQ_M2))
    )


def hlg_to_linear(e: Column) -> Column:
    v = F.greatest(e, F.lit(0.0))
    return F.when(v <= 0.5, v * v / 3.0).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12.0)


def linear_to_hlg(x: Column) -> Column:
    v = F.greatest(x, F.lit(0.0))
    toe = v <= 1 / 12
    return F.when(toe, F.sqrt(v * 3.0)).otherwise(
        F.lit(HLG_A) * F.log(F.when(~toe, v * 12.0 - HLG_B)) + HLG_C
    )


def srgb_to_linear(e: Column) -> Column:
    v = clamp(e, 0, 1)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    v = clamp(x, 0, 1)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def matrix(rgb: RGB, rows: tuple) -> RGB:
    r, g, b = rgb
    return tuple(r * m[0] + g * m[1] + b * m[2] for m in rows)


def aces(x: Column) -> Column:
    v = F.greatest(x, F.lit(0.0))
    return clamp((v * (v * 2.51 + 0.03)) / (v * (v * 2.43 + 0.59) + 0.14), 0, 1)


def reinhard(x: Column) -> Column:
    v = F.greatest(x, F.lit(0.0))
    return v / (v + 1.0)


def luma(rgb: RGB) -> Column:
    return rgb[0] * LUMA[0] + rgb[1] * LUMA[1] + rgb[2] * LUMA[2]


def to_code8(sample: Column) -> Column:
    """8-bit code of a sample in 0..1, halves up."""
    return F.floor(sample * 255.0 + 0.5).cast("int")


def smoothstep(lo: Column, hi: Column, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo), 0, 1)
    return t * t * (F.lit(3.0) - t * 2.0)


def _light(s: Column, d: Column, low: Column) -> Column:
    return F.when(low, s * d * 2.0).otherwise(F.lit(1.0) - (F.lit(1.0) - s) * (F.lit(1.0) - d) * 2.0)


# What each mode makes of one source and one backdrop channel.
BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "Normal": lambda s, d: s,
    "Add": lambda s, d: F.least(s + d, F.lit(1.0)),
    "Multiply": lambda s, d: s * d,
    "Screen": lambda s, d: F.lit(1.0) - (F.lit(1.0) - s) * (F.lit(1.0) - d),
    "Overlay": lambda s, d: _light(s, d, d < 0.5),
    "Darken": lambda s, d: F.least(s, d),
    "Lighten": lambda s, d: F.greatest(s, d),
    "ColorDodge": lambda s, d: F.when(s >= 1, 1.0).otherwise(F.least(d / F.when(s < 1, F.lit(1.0) - s), F.lit(1.0))),
    "ColorBurn": lambda s, d: F.when(s <= 0, 0.0).otherwise(
        F.greatest(F.lit(1.0) - (F.lit(1.0) - d) / F.when(s > 0, s), F.lit(0.0))
    ),
    "HardLight": lambda s, d: _light(s, d, s < 0.5),
    "SoftLight": lambda s, d: (F.lit(1.0) - s * 2.0) * d * d + s * d * 2.0,
    "Difference": lambda s, d: F.abs(s - d),
    "Exclusion": lambda s, d: s + d - s * d * 2.0,
}


def blend_channel(mode: Column, s: Column, d: Column) -> Column:
    out = F
    for name, fn in BLENDS.items():
        if name != "Normal":
            out = out.when(mode == name, fn(s, d))
    return out.otherwise(s)


def source_over(mode: Column, src: Column, dst: Column) -> Column:
    """STRUCT<r,g,b,a> of ``src`` blended over ``dst``, both such structs."""
    sa, da = src["a"], dst["a"]
    a = sa + da * (F.lit(1.0) - sa)
    visible = a > 1.1920929e-07

    def channel(c: str) -> Column:
        s, d = src[c], dst[c]
        mixed = sa * (F.lit(1.0) - da) * s + da * (F.lit(1.0) - sa) * d + sa * da * blend_channel(mode, s, d)
        return F.when(visible, mixed / F.when(visible, a)).otherwise(0.0).alias(c)

    return F.struct(*[channel(c) for c in "rgb"], F.when(visible, a).otherwise(0.0).alias("a"))


def matte_gain(mode: Column, r: Column, g: Column, b: Column, a: Column) -> Column:
    """Multiplier a matte pixel gives the layer below it."""
    y = luma((r, g, b))
    return (
        F.when(mode == "AlphaMatte", clamp(a, 0, 1))
        .when(mode == "AlphaMatteInverted", clamp(F.lit(1.0) - a, 0, 1))
        .when(mode == "LumaMatte", clamp(y, 0, 1))
        .when(mode == "LumaMatteInverted", clamp(F.lit(1.0) - y, 0, 1))
        .otherwise(1.0)
    )
