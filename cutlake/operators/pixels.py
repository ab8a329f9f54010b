"""Picture operators over pixel tables ``(frame_id, x, y, r, g, b, a)``.

Point operators join the pixels to a parameter table of one row per picture and
evaluate generated expressions; the partitioning by picture is kept between them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions import colour as cx
from cutlake.functions.arith import clamp, idiv
from cutlake.operators.quantiles import nearest_rank, order_statistics
from cutlake.operators.windows import gaussian_lines, map_lines

FRAME = ("frame_id",)


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _set(rgb: Sequence[Column]) -> dict[str, Column]:
    return dict(zip("rgb", rgb))


def _keep(out: DataFrame, like: DataFrame) -> DataFrame:
    return out.select(*like.columns)


# Fixed values: (Kr, Kb) by matrix.
LUMA_COEFFICIENTS = {"Bt601": (0.299, 0.114), "Bt2020": (0.2627, 0.0593), "Bt709": (0.2126, 0.0722)}


def yuv_coefficients(profiles: DataFrame) -> DataFrame:
    """Conversion numbers of each picture's ``(matrix, range, bit_depth, semi_planar)``."""

    def pick(i: int) -> Column:
        out = F
        for name, k in LUMA_COEFFICIENTS.items():
            out = out.when(F.col("matrix") == name, F.lit(k[i]))
        return out.otherwise(F.lit(LUMA_COEFFICIENTS["Bt709"][i]))

    depth = F.when(F.col("bit_depth") == 0, 8).otherwise(F.col("bit_depth"))
    limited = F.col("range") != "Full"
    step = F.pow(F.lit(2.0), F.col("depth") - 8)
    top = F.col("top")
    staged = profiles.withColumns({"kr": pick(0), "kb": pick(1), "depth": depth}).withColumn(
        "top", F.pow(F.lit(2.0), F.col("depth")) - 1
    )
    sample_scale = (
        F.when(F.col("depth") <= 8, 1.0)
        .when(F.col("semi_planar"), F.lit(65535.0) / (top * F.pow(F.lit(2.0), F.lit(16) - F.col("depth"))))
        .otherwise(F.lit(65535.0) / top)
    )
    return staged.withColumns(
        {
            "kg": F.lit(1.0) - F.col("kr") - F.col("kb"),
            "sample_scale": sample_scale,
            "luma_offset": F.when(limited, step * 16 / top).otherwise(0.0),
            "luma_span": F.when(limited, step * 219 / top).otherwise(1.0),
            "chroma_offset": step * 128 / top,
            "chroma_span": F.when(limited, step * 224 / top).otherwise(1.0),
        }
    ).drop("depth", "top")


def yuv_to_rgb(luma: DataFrame, chroma: DataFrame, profiles: DataFrame) -> DataFrame:
    """RGB from ``luma(frame_id, x, y, v)`` and half-size ``chroma(frame_id, cx, cy, cb, cr)``.

    ``profiles`` has one row per picture, with the chroma size ``chroma_w, chroma_h``;
    the last odd row and column use the nearest chroma sample. Not clamped.
    """
    p = yuv_coefficients(profiles)
    at = luma.join(p, "frame_id").withColumns(
        {
            "cx": F.least(idiv(F.col("x"), F.lit(2)), F.col("chroma_w") - 1),
            "cy": F.least(idiv(F.col("y"), F.lit(2)), F.col("chroma_h") - 1),
        }
    )

    def centred(c: str) -> Column:
        return (F.col(c) * F.col("sample_scale") - F.col("chroma_offset")) / F.col("chroma_span")

    j = at.join(chroma, ["frame_id", "cx", "cy"]).withColumns(
        {
            "v": (F.col("v") * F.col("sample_scale") - F.col("luma_offset")) / F.col("luma_span"),
            "cb": centred("cb"),
            "cr": centred("cr"),
        }
    )
    kr, kg, kb, y, cb, cr = (F.col(c) for c in ("kr", "kg", "kb", "v", "cb", "cr"))
    one = F.lit(1.0)
    green = y - kr * (one - kr) * 2 / kg * cr - kb * (one - kb) * 2 / kg * cb
    return j.select(
        "frame_id", "x", "y", (y + (one - kr) * 2 * cr).alias("r"), green.alias("g"), (y + (one - kb) * 2 * cb).alias("b")
    )


def _to_yuv(rgb: Sequence[Column]) -> dict[str, Column]:
    kr, kg, kb = F.col("kr"), F.col("kg"), F.col("kb")
    r, g, b = (clamp(c, 0, 1) for c in rgb)
    y = kr * r + kg * g + kb * b
    return {
        "yy": y * F.col("luma_span") + F.col("luma_offset"),
        "cb": (b - y) / ((F.lit(1.0) - kb) * 2) * F.col("chroma_span") + F.col("chroma_offset"),
        "cr": (r - y) / ((F.lit(1.0) - kr) * 2) * F.col("chroma_span") + F.col("chroma_offset"),
    }


def rgb_to_yuv(pixels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Full-size Y, Cb, Cr samples in 0..1 and their 8-bit codes; RGB is clamped first."""
    out = pixels.join(yuv_coefficients(profiles), "frame_id").withColumns(_to_yuv(_rgb()))
    codes = [cx.to_code8(F.col(c)).alias(f"{c}_code") for c in ("yy", "cb", "cr")]
    return out.select("frame_id", "x", "y", "yy", "cb", "cr", *codes)


def subsample_420(pixels: DataFrame, profiles: DataFrame) -> DataFrame:
    """8-bit Cb/Cr codes at half size, from the mean colour of each 2x2 block.

    Repeating an odd edge leaves the mean of its block unchanged.
    """
    blocks = pixels.groupBy(
        "frame_id", idiv(F.col("x"), F.lit(2)).alias("cx"), idiv(F.col("y"), F.lit(2)).alias("cy")
    ).agg(*[F.avg(clamp(F.col(c), 0, 1)).alias(c) for c in "rgb"])
    out = blocks.join(yuv_coefficients(profiles), "frame_id").withColumns(_to_yuv(_rgb()))
    codes = [cx.to_code8(clamp(F.col(c), 0, 1)).alias(c) for c in ("cb", "cr")]
    return out.select("frame_id", "cx", "cy", *codes)


REFERENCE_NITS = 100.0
DEFAULT_PEAK_NITS = 1000.0


def conversion_params(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per picture: which curves, matrix and tone mapping take it to its job's output.

    ``profiles(frame_id, job_id, transfer_fn, primaries)``, ``jobs(job_id,
    out_transfer, out_primaries, peak_nits)``. Pictures that need nothing are left out.
    """
    hdr = ("Pq", "Hlg")
    j = profiles.join(jobs, "job_id")
    to_hdr, is_hdr = F.col("out_transfer").isin(*hdr), F.col("transfer_fn").isin(*hdr)
    gamut = F.when((F.col("primaries") == "Bt2020") & (F.col("out_primaries") == "Bt709"), "To709").when(
        (F.col("primaries") == "Bt709") & (F.col("out_primaries") == "Bt2020"), "To2020"
    ).otherwise("None")
    curve = F.when(F.col("transfer_fn").isin(*hdr, "Linear"), F.col("transfer_fn")).otherwise("Srgb")
    out_curve = F.when(~to_hdr, "Srgb").when(F.col("out_transfer") == "Hlg", "Hlg").otherwise("Pq")
    j = j.withColumn("gamut", gamut).where(to_hdr | is_hdr | (F.col("gamut") != "None"))
    peak = F.when(to_hdr, F.coalesce("peak_nits", F.lit(DEFAULT_PEAK_NITS))).otherwise(DEFAULT_PEAK_NITS)
    return j.select(
        "frame_id", curve.alias("curve"), "gamut", F.when(to_hdr, "Passthrough").otherwise("Aces").alias("tonemap"),
        out_curve.alias("out_curve"), peak.alias("peak"), F.lit(1.0).alias("exposure"),
    )


def convert_color(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Exposure, decode, primaries, tone map, encode - for pictures in ``params`` only."""
    ref = F.lit(REFERENCE_NITS)
    j = pixels.join(params.withColumn("__on", F.lit(True)), "frame_id", "left")
    old = {f"__{c}": F.col(c) for c in "rgb"}
    j = j.withColumns(old)

    def decode(c: Column) -> Column:
        v = c * F.col("exposure")
        return (
            F.when(F.col("curve") == "Pq", cx.pq_to_nits(v) / ref)
            .when(F.col("curve") == "Hlg", cx.hlg_to_linear(v) * (F.col("peak") / ref))
            .when(F.col("curve") == "Srgb", cx.srgb_to_linear(v))
            .otherwise(v)
        )

    j = j.withColumns(_set([decode(c) for c in _rgb()]))
    to709, to2020 = cx.matrix(_rgb(), cx.TO_709), cx.matrix(_rgb(), cx.TO_2020)
    j = j.withColumns(
        _set(
            [
                F.when(F.col("gamut") == "To709", a).when(F.col("gamut") == "To2020", b).otherwise(c)
                for a, b, c in zip(to709, to2020, _rgb())
            ]
        )
    )

    def tone(c: Column) -> Column:
        mode = F.col("tonemap")
        return (
            F.when(mode == "Aces", cx.aces(c))
            .when(mode == "Reinhard", cx.reinhard(c))
            .when(mode == "Clamp", clamp(c, 0, 1))
            .otherwise(F.greatest(c, F.lit(0.0)))
        )

    j = j.withColumns(_set([tone(c) for c in _rgb()]))

    def encode(c: Column) -> Column:
        curve = F.col("out_curve")
        scaled = clamp(c * (ref / F.greatest(F.col("peak"), F.lit(1.0))), 0, 1)
        return (
            F.when(curve == "Pq", cx.nits_to_pq(c * ref))
            .when(curve == "Hlg", cx.linear_to_hlg(scaled))
            .when(curve == "Srgb", cx.linear_to_srgb(c))
            .otherwise(c)
        )

    on = F.col("__on").isNotNull()
    j = j.withColumns(_set([F.when(on, encode(F.col(c))).otherwise(F.col(f"__{c}")) for c in "rgb"]))
    return _keep(j, pixels)


def _hue_rotated(rgb, theta: Column) -> list[Column]:
    r, g, b = rgb
    k0, k1, k2 = (F.lit(k) for k in cx.LUMA)
    c, s = F.cos(theta), F.sin(theta)
    d = F.lit(1.0) - c
    out = [
        r * (c + d * k0) + g * (k0 * d - k2 * s) + b * (k0 * d + k1 * s),
        r * (k1 * d + k2 * s) + g * (c + d * k1) + b * (k1 * d - k0 * s),
        r * (k2 * d - k1 * s) + g * (k2 * d + k0 * s) + b * (c + d * k2),
    ]
    return [F.greatest(x, F.lit(0.0)) for x in out]


# Grade parameters that change nothing.
NEUTRAL_GRADE = {
    **{f"lift_{c}": 0.0 for c in "rgb"}, **{f"gamma_{c}": 1.0 for c in "rgb"}, **{f"gain_{c}": 1.0 for c in "rgb"},
    "saturation": 1.0, "brightness": 0.0, "contrast": 1.0, "hue_shift": 0.0,
}
_BAND = 0.001


def grade(pixels: DataFrame, state: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Lift, gamma, gain, brightness/contrast, saturation, hue (radians), in that order.

    Absent parameter columns are neutral; adjustments within 0.001 of neutral are
    skipped. Pictures without a state row pass unchanged.
    """
    keys = list(keys)
    given = [c for c in NEUTRAL_GRADE if c in state.columns]
    params = state.select(*keys, *[F.col(c).alias(f"__{c}") for c in given])
    j = pixels.join(params, keys, "left")
    j = j.withColumns({f"__{c}": F.coalesce(F.col(f"__{c}") if c in given else F.lit(None), F.lit(v)) for c, v in NEUTRAL_GRADE.items()})

    def p(name: str) -> Column:
        return F.col(f"__{name}")

    def channel(c: str) -> Column:
        lifted = F.col(c) + p(f"lift_{c}") * (F.lit(1.0) - F.col(c))
        curved = F.pow(F.greatest(lifted, F.lit(0.0)), F.lit(1.0) / F.when(p(f"gamma_{c}") > 0, p(f"gamma_{c}")))
        # A neutral lift and gamma must not clip what lies below zero.
        return F.when(p(f"gamma_{c}") > 0, curved).otherwise(lifted) * p(f"gain_{c}")

    j = j.withColumns({c: channel(c) for c in "rgb"})
    bc = (F.abs(p("contrast") - 1) > _BAND) | (F.abs(p("brightness")) > _BAND)
    scale = F.greatest(p("contrast"), F.lit(0.0))
    j = j.withColumns(
        _set([F.when(bc, F.greatest((c - 0.5) * scale + 0.5 + p("brightness"), F.lit(0.0))).otherwise(c) for c in _rgb()])
    )
    y, amount = cx.luma(_rgb()), F.greatest(p("saturation"), F.lit(0.0))
    sat = F.abs(p("saturation") - 1) > _BAND
    j = j.withColumns(
        _set([F.when(sat, F.greatest(y * (F.lit(1.0) - amount) + c * amount, F.lit(0.0))).otherwise(c) for c in _rgb()])
    )
    hue = F.abs(p("hue_shift")) > _BAND
    j = j.withColumns(
        _set([F.when(hue, h).otherwise(c) for h, c in zip(_hue_rotated(_rgb(), p("hue_shift")), _rgb())])
    )
    return _keep(j, pixels)


def lut_cells(luts: DataFrame) -> DataFrame:
    """One row per LUT cell with its eight corners, so a pixel needs one lookup."""
    corner = F.explode(F.array(*[F.struct(F.lit(i >> 2).alias("dr"), F.lit(i >> 1 & 1).alias("dg"), F.lit(i & 1).alias("db")) for i in range(8)]))
    spread = luts.withColumn("c", corner).select(
        "lut_id", "size", *[(F.col(f"{a}i") - F.col(f"c.d{a}")).alias(f"{a}0") for a in "rgb"],
        (F.col("c.dr") * 4 + F.col("c.dg") * 2 + F.col("c.db")).alias("corner"), F.struct("r", "g", "b").alias("v"),
    )
    inside = [(F.col(f"{a}0") >= 0) & (F.col(f"{a}0") <= F.col("size") - 2) for a in "rgb"]
    spread = spread.where(inside[0] & inside[1] & inside[2])
    return spread.groupBy("lut_id", "size", "r0", "g0", "b0").agg(
        *[F.max(F.when(F.col("corner") == i, F.col("v"))).alias(f"c{i}") for i in range(8)]
    )


def apply_lut(pixels: DataFrame, use: DataFrame, luts: DataFrame) -> DataFrame:
    """Trilinear lookup, mixed in by strength. ``use(frame_id, lut_id, strength)``."""
    sizes = luts.groupBy("lut_id").agg(F.max("size").alias("__n"))
    j = pixels.join(use.join(sizes, "lut_id"), "frame_id", "left")
    top = (F.col("__n") - 1).cast("double")
    pos = {c: F.least(F.greatest(F.col(c) * top, F.lit(0.0)), top) for c in "rgb"}
    j = j.withColumns({f"{c}p": pos[c] for c in "rgb"})
    j = j.withColumns({f"{c}0": F.least(F.floor(f"{c}p"), F.col("__n") - 2).cast("int") for c in "rgb"})
    cells = lut_cells(luts).drop("size")
    j = j.join(cells, ["lut_id", "r0", "g0", "b0"], "left")
    d = {c: F.col(f"{c}p") - F.col(f"{c}0") for c in "rgb"}

    def lerp(a: Column, b: Column, t: Column) -> Column:
        return a + (b - a) * t

    def value(c: str) -> Column:
        v = [F.col(f"c{i}.{c}") for i in range(8)]
        along_b = [lerp(v[2 * i], v[2 * i + 1], d["b"]) for i in range(4)]
        along_g = [lerp(along_b[2 * i], along_b[2 * i + 1], d["g"]) for i in range(2)]
        return lerp(along_g[0], along_g[1], d["r"])

    mixed = {c: F.coalesce(lerp(F.col(c), value(c), F.col("strength")), F.col(c)) for c in "rgb"}
    return _keep(j.withColumns(mixed), pixels)


def key_params(state: DataFrame) -> DataFrame:
    """Chroma key numbers from the clip's key colour, tolerance and softness."""
    r, g, b = (F.col(f"key_{c}").cast("double") for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    eps = 1.1920929e-07
    d = F.when(hi - lo > eps, hi - lo)
    sixth = F.pmod((g - b) / d, F.lit(6.0))
    hue = (
        F.when(d.isNull(), 0.0)
        .when(F.abs(hi - r) <= eps, sixth * 60)
        .when(F.abs(hi - g) <= eps, ((b - r) / d + 2) * 60)
        .otherwise(((r - g) / d + 4) * 60)
    )
    wide = F.col("chroma_key_tolerance") * 180
    soft = F.greatest(F.least(F.col("chroma_key_softness") * 180, wide - 0.1), F.lit(0.01))
    return state.withColumns(
        {
            "key_hue": hue, "tolerance": F.greatest(wide, F.lit(1.0)), "softness": soft, "min_value": F.lit(0.05),
        }
    )


def chroma_key(pixels: DataFrame, params: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Fade out pixels near the key hue and take its spill out of the rest.

    ``params(keys, key_hue, tolerance, softness, min_saturation, min_value,
    spill_suppress)``, hue in degrees.
    """
    keys = list(keys)
    names = ["key_hue", "tolerance", "softness", "min_saturation", "min_value", "spill_suppress"]
    j = pixels.join(params.select(*keys, *[F.col(n).alias(f"__{n}") for n in names]), keys, "left")
    r, g, b = _rgb()
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    j = j.withColumns({"__v": hi, "__d": hi - lo})
    d = F.when(F.col("__d") >= 0.0001, F.col("__d"))
    sixth = F.pmod((g - b) / d, F.lit(6.0))
    hue = F.when(F.col("__v") == r, sixth * 60).when(F.col("__v") == g, ((b - r) / d + 2) * 60).otherwise(((r - g) / d + 4) * 60)
    sat = F.when(F.col("__v") > 0.0001, F.col("__d") / F.when(F.col("__v") > 0.0001, F.col("__v"))).otherwise(0.0)
    far = F.abs(F.coalesce(hue, F.lit(0.0)) - F.col("__key_hue"))
    j = j.withColumns({"__dist": F.least(far, F.lit(360.0) - far), "__s": sat})
    t = clamp((F.col("__tolerance") - F.col("__dist")) / F.greatest(F.col("__softness"), F.lit(0.0001)), 0, 1)
    hit = (F.col("__s") > F.col("__min_saturation")) & (F.col("__v") > F.col("__min_value"))
    j = j.withColumn("__m", F.when(hit, t * t * (F.lit(3.0) - t * 2)).otherwise(0.0))
    part = F.col("__spill_suppress") * F.col("__m")
    spill = (F.col("__spill_suppress") > 0) & (F.col("__m") > 0)
    green = (F.col("__key_hue") > 60) & (F.col("__key_hue") < 180)

    def toned(c: Column, others: Column) -> Column:
        return c * (F.lit(1.0) - part) + F.least(c, others) * part

    return _keep(
        j.withColumns(
            {
                "g": F.when(spill & green, toned(g, (r + b) / 2)).otherwise(g),
                "b": F.when(spill & ~green, toned(b, (r + g) / 2)).otherwise(b),
                "a": F.col("a") * (F.lit(1.0) - F.col("__m")),
            }
        ),
        pixels,
    )


def vignette(pixels: DataFrame, state: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Darken towards the edges. ``state(keys, intensity, radius, softness, roundness, width, height)``.

    Optional ``center_x, center_y`` default to the middle.
    """
    keys = list(keys)
    names = ["intensity", "radius", "softness", "roundness", "width", "height"]
    centre = {c: F.col(c) if c in state.columns else F.lit(0.5) for c in ("center_x", "center_y")}
    params = state.select(*keys, *[F.col(n).alias(f"__{n}") for n in names], *[v.alias(f"__{n}") for n, v in centre.items()])
    j = pixels.join(params, keys, "left")
    w, h = F.col("__width"), F.col("__height")
    dx, dy = F.col("x") / w - F.col("__center_x"), F.col("y") / h - F.col("__center_y")
    aspect = w / F.greatest(h, F.lit(1))
    oval = F.sqrt(dx * dx + dy * dy) * 2
    round_ = F.sqrt(dx * aspect * dx * aspect + dy * dy) * 2 / aspect
    dist = oval * (F.lit(1.0) - F.col("__roundness")) + round_ * F.col("__roundness")
    inner = F.greatest(F.col("__radius") - F.col("__softness"), F.lit(0.0))
    fall = cx.smoothstep(inner, F.col("__radius") + F.col("__softness"), dist)
    gain = clamp(F.lit(1.0) - fall * F.col("__intensity"), 0, 1)
    j = j.withColumn("__g", F.when(F.col("__intensity") > 0.001, gain).otherwise(1.0))
    return _keep(j.withColumns({c: F.col(c) * F.col("__g") for c in "rgb"}), pixels)


def blur(pixels: DataFrame, state: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Gaussian blur, across then down. ``state(keys, blur_radius, blur_sigma)``."""
    keys = list(keys)
    j = pixels.join(state.select(*keys, F.col("blur_radius").alias("__r"), F.col("blur_sigma").alias("__s")), keys, "left")
    across = gaussian_lines(j, "__r", "__s", "x", keys)
    return _keep(gaussian_lines(across, "__r", "__s", "y", keys), pixels)


def sharpen(pixels: DataFrame, state: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Unsharp with the four neighbours, edges repeated. ``state(keys, sharpen_amount)``.

    Windows run along single picture lines.
    """
    keys = list(keys)
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    j = pixels
    for w in (row, col):
        tag = "h" if w is row else "v"
        j = j.withColumns(
            {f"__{tag}{c}": F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c)) for c in "rgb"}
        )
    j = j.join(state.select(*keys, F.col("sharpen_amount").alias("__amount")), keys, "left")

    def sharp(c: str) -> Column:
        mean = (F.col(f"__h{c}") + F.col(f"__v{c}")) * 0.25
        out = F.greatest(F.col(c) + (F.col(c) - mean) * F.col("__amount"), F.lit(0.0))
        return F.when(F.col("__amount") > 0.001, out).otherwise(F.col(c))

    return _keep(j.withColumns({c: sharp(c) for c in "rgb"}), pixels)


def _crop_alpha(u: Column, v: Column, rect: Column) -> Column:
    half = rect["feather"] * 0.5
    soft = F.when(half > 0, half)

    def ramp(d: Column) -> Column:
        return clamp(d / soft, 0, 1)

    inside = u.between(rect["left"], rect["right"]) & v.between(rect["top"], rect["bottom"])
    feathered = F.least(
        ramp(u - rect["left"]), ramp(rect["right"] - u), ramp(v - rect["top"]), ramp(rect["bottom"] - v)
    )
    return F.when(rect["feather"] < 1.1920929e-07, F.when(inside, 1.0).otherwise(0.0)).otherwise(feathered)


def _ellipse_alpha(u: Column, v: Column, e: Column) -> Column:
    ok = (e["rx"] > 0) & (e["ry"] > 0)
    dx, dy = (u - e["cx"]) / F.when(ok, e["rx"]), (v - e["cy"]) / F.when(ok, e["ry"])
    dist = F.sqrt(dx * dx + dy * dy)
    feather = e["feather"]
    soft = clamp((dist * -1 + 1 + feather * 0.5) / F.when(feather > 0, feather), 0, 1)
    hard = F.when(dist <= 1, 1.0).otherwise(0.0)
    return F.when(~ok, 0.0).when(feather < 1.1920929e-07, hard).otherwise(soft)


def _polygon_alpha(u: Column, v: Column, points: Column) -> Column:
    """Even-odd test of every edge (previous vertex, vertex)."""
    n = F.size(points)
    before = F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > v) != (b["y"] > v)
        at = F.try_divide((b["x"] - a["x"]) * (v - a["y"]), b["y"] - a["y"]) + a["x"]
        return spans & F.coalesce(u < at, F.lit(False))

    edges = F.arrays_zip(points.alias("a"), before.alias("b"))
    hits = F.size(F.filter(edges, crosses))
    return F.when(n < 3, 1.0).when(hits % 2 == 1, 1.0).otherwise(0.0)


def mask(pixels: DataFrame, masks: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Multiply alpha by a shape: ``masks(keys, kind, rect, ellipse, points)``.

    Pixels carry their position in the clip as ``u, v``. Kinds Rectangle, Ellipse,
    Polygon; a polygon's feather is ignored and below three points it masks nothing.
    """
    keys = list(keys)
    j = pixels.join(masks.select(*keys, F.struct("kind", "rect", "ellipse", "points").alias("__m")), keys, "left")
    m, u, v = F.col("__m"), F.col("u"), F.col("v")
    gain = (
        F.when(m["kind"] == "Rectangle", _crop_alpha(u, v, m["rect"]))
        .when(m["kind"] == "Ellipse", _ellipse_alpha(u, v, m["ellipse"]))
        .when(m["kind"] == "Polygon", _polygon_alpha(u, v, m["points"]))
    )
    return _keep(j.withColumn("a", F.col("a") * F.coalesce(gain, F.lit(1.0))), pixels)


def matte(layers: DataFrame, mattes: DataFrame) -> DataFrame:
    """Multiply a layer's alpha by its matte picture's alpha or luma.

    ``layers(frame_id, x, y, ..., matte_mode, matte_id)``, ``mattes(matte_id,
    frame_id, x, y, r, g, b, a)``. Without a matte pixel a layer stays as it is.
    """
    at = ["matte_id", "frame_id", "x", "y"]
    m = mattes.select(*at, *[F.col(c).alias(f"__{c}") for c in "rgba"])
    j = layers.join(m, at, "left")
    gain = cx.matte_gain(F.col("matte_mode"), *[F.col(f"__{c}") for c in "rgba"])
    return _keep(j.withColumn("a", F.col("a") * F.coalesce(gain, F.lit(1.0))), layers)


def composite(layers: DataFrame) -> DataFrame:
    """Blend the layers of every pixel bottom to top.

    ``layers(frame_id, x, y, layer_order, clip_id, blend_mode, r, g, b, a)``. Blending
    is not associative, so a pixel's layers are folded in order; there are at most as
    many as 16-bit layer numbers, whatever the size of the table.
    """
    item = F.struct("layer_order", "clip_id", "blend_mode", "r", "g", "b", "a")
    stacks = layers.groupBy("frame_id", "x", "y").agg(F.array_sort(F.collect_list(item)).alias("s"))
    clear = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])
    out = F.aggregate("s", clear, lambda acc, s: cx.source_over(s["blend_mode"], s, acc))
    return stacks.select("frame_id", "x", "y", out.alias("p")).select("frame_id", "x", "y", "p.*")


def affine(clips: DataFrame) -> DataFrame:
    """UV-to-NDC matrix of each clip, column by column as ``m0..m5``.

    ``clips(..., position_x, position_y, scale_x, scale_y, rotation, anchor_x,
    anchor_y, clip_w, clip_h, canvas_w, canvas_h)``; rotation counts anticlockwise.
    """
    s, c = F.sin(-F.col("rotation")), F.cos(-F.col("rotation"))
    sx, sy, w, h = (F.col(n) for n in ("scale_x", "scale_y", "clip_w", "clip_h"))
    ax, ay = F.col("anchor_x") * w, F.col("anchor_y") * h
    tx, ty = F.col("position_x") + F.col("canvas_w") * 0.5, F.col("position_y") + F.col("canvas_h") * 0.5
    nx, ny = F.lit(2.0) / F.col("canvas_w"), F.lit(-2.0) / F.col("canvas_h")
    return clips.withColumns(
        {
            "m0": sx * c * w * nx,
            "m1": sx * s * w * ny,
            "m2": -sy * s * h * nx,
            "m3": sy * c * h * ny,
            "m4": (tx - (ax * sx * c - ay * sy * s)) * nx - 1,
            "m5": (ty - (ax * sx * s + ay * sy * c)) * ny + 1,
        }
    )


def place(clips: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Canvas pixels each clip covers, with the clip position ``u, v`` at their centre.

    Only the rows and columns of the clip's bounding box are generated, line by line.
    """
    keys = list(keys)
    m = affine(clips)
    det = F.col("m0") * F.col("m3") - F.col("m1") * F.col("m2")
    m = m.withColumn("__det", det).where(F.abs("__det") > 1e-12)

    def to_px(col: str, i: str, j: str, size: str, flip: bool) -> list[Column]:
        corners = [F.col(col) + F.col(i) * a + F.col(j) * b for a in (0, 1) for b in (0, 1)]
        if flip:
            return [(F.lit(1.0) - n) / 2 * F.col(size) for n in corners]
        return [(n + 1) / 2 * F.col(size) for n in corners]

    xs, ys = to_px("m4", "m0", "m2", "canvas_w", False), to_px("m5", "m1", "m3", "canvas_h", True)

    def span(px: list[Column], size: str) -> Column:
        lo = F.greatest(F.floor(F.least(*px)), F.lit(0)).cast("int")
        hi = F.least(F.ceil(F.greatest(*px)), F.col(size)).cast("int") - 1
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    m = m.withColumn("y", F.explode(span(ys, "canvas_h")))
    m = m.withColumn("x", F.explode(span(xs, "canvas_w")))
    px = (F.col("x") + 0.5) / F.col("canvas_w") * 2 - 1 - F.col("m4")
    py = F.lit(1.0) - (F.col("y") + 0.5) / F.col("canvas_h") * 2 - F.col("m5")
    m = m.withColumns(
        {
            "u": (px * F.col("m3") - py * F.col("m2")) / F.col("__det"),
            "v": (py * F.col("m0") - px * F.col("m1")) / F.col("__det"),
        }
    )
    return m.where(F.col("u").between(0, 1) & F.col("v").between(0, 1)).select(*keys, "x", "y", "u", "v")


def to_lab(pixels: DataFrame, names: Sequence[str] = ("l", "a", "b")) -> DataFrame:
    """CIELAB (D65) of linear sRGB pixels as ``(frame_id, x, y, names...)``."""

    def f(c: str) -> Column:
        t = F.col(c)
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29)

    r, g, b = _rgb()
    # Linear sRGB to XYZ, D65 white.
    xyz = pixels.select(
        "frame_id", "x", "y",
        ((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047).alias("__x"),
        (r * 0.2126729 + g * 0.7151522 + b * 0.0721750).alias("__y"),
        ((r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883).alias("__z"),
    ).withColumns({c: f(c) for c in ("__x", "__y", "__z")})
    fx, fy, fz = (F.col(c) for c in ("__x", "__y", "__z"))
    lab = (fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200)
    return xyz.select("frame_id", "x", "y", *[c.alias(n) for c, n in zip(lab, names)])


def lab_difference(df: DataFrame, out: str = "delta_e") -> DataFrame:
    """CIEDE2000 of ``l1,a1,b1`` and ``l2,a2,b2``, staged so nothing is computed twice."""
    seven = float(25**7)

    def col(*names: str) -> list[Column]:
        return [F.col(n) for n in names]

    def sq(c: Column) -> Column:
        return c * c

    def rad(c: Column) -> Column:
        return F.radians(c)

    a1, b1, a2, b2 = col("a1", "b1", "a2", "b2")
    c7 = F.pow((F.sqrt(sq(a1) + sq(b1)) + F.sqrt(sq(a2) + sq(b2))) / 2, F.lit(7.0))
    j = df.withColumn("__g", (F.lit(1.0) - F.sqrt(c7 / (c7 + seven))) * 0.5 + 1)
    j = j.withColumns({"__p1": a1 * F.col("__g"), "__p2": a2 * F.col("__g")})

    def hue(b: Column, p: Column) -> Column:
        h = F.degrees(F.atan2(b, p))
        return F.when(h < 0, h + 360).otherwise(h)

    p1, p2 = col("__p1", "__p2")
    j = j.withColumns(
        {
            "__c1": F.sqrt(sq(p1) + sq(b1)), "__c2": F.sqrt(sq(p2) + sq(b2)),
            "__h1": hue(b1, p1), "__h2": hue(b2, p2),
        }
    )
    c1, c2, h1, h2 = col("__c1", "__c2", "__h1", "__h2")
    grey, turn, both = c1 * c2 < 1e-12, h2 - h1, h1 + h2
    dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
    hm = (
        F.when(grey, both).when(F.abs(turn) <= 180, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
    )
    j = j.withColumns(
        {
            "__dh": F.sqrt(c1 * c2) * 2 * F.sin(rad(dh / 2)), "__hm": hm, "__cm": (c1 + c2) / 2,
            "__l50": sq((F.col("l1") + F.col("l2")) / 2 - 50),
        }
    )
    hm, cm, l50 = col("__hm", "__cm", "__l50")
    t = (
        F.lit(1.0) - F.cos(rad(hm - 30)) * 0.17 + F.cos(rad(hm) * 2) * 0.24 + F.cos(rad(hm * 3 + 6)) * 0.32
        - F.cos(rad(hm * 4 - 63)) * 0.20
    )
    cm7 = F.pow(cm, F.lit(7.0))
    theta = F.exp(-sq((hm - 275) / 25)) * 30
    j = j.withColumns(
        {
            "__tl": (F.col("l2") - F.col("l1")) / (l50 * 0.015 / F.sqrt(l50 + 20) + 1),
            "__tc": (c2 - c1) / (cm * 0.045 + 1),
            "__th": F.col("__dh") / (cm * t * 0.015 + 1),
            "__rt": -F.sin(rad(theta) * 2) * F.sqrt(cm7 / (cm7 + seven)) * 2,
        }
    )
    tl, tc, th, rt = col("__tl", "__tc", "__th", "__rt")
    # Rounding can push equal colours a hair below zero.
    total = F.greatest(sq(tl) + sq(tc) + sq(th) + rt * tc * th, F.lit(0.0))
    return j.withColumn(out, F.sqrt(total)).select(*df.columns, out)


def delta_e(a: DataFrame, b: DataFrame) -> DataFrame:
    """CIEDE2000 between two renders of linear-light pixels: mean, p95, max per picture.

    The figures are over the pixels both have; ``missing`` counts those only one has. A
    picture that shares no pixel has NULL figures.
    """
    at = ["frame_id", "x", "y"]
    la, lb = to_lab(a, ("l1", "a1", "b1")), to_lab(b, ("l2", "a2", "b2"))
    both = F.col("l1").isNotNull() & F.col("l2").isNotNull()
    met = la.join(lb, at, "full")
    missing = met.groupBy("frame_id").agg(F.count(F.when(~both, 1)).alias("missing"))
    d = lab_difference(met.where(both))
    stats = d.groupBy("frame_id").agg(F.avg("delta_e").alias("mean_de"), F.max("delta_e").alias("max_de"))
    tail = order_statistics(d, ["frame_id"], "delta_e", {"p95_de": nearest_rank(0.95)}).drop("n")
    return missing.join(stats.join(tail, "frame_id"), "frame_id", "left")


def render_clips(pixels: DataFrame, state: DataFrame, keys: Sequence[str] = ("frame_id", "clip_id")) -> DataFrame:
    """Each clip picture through its enabled effects: grade, blur, sharpen, vignette, key.

    ``state`` is one row per clip picture with the effect switches, the attributes
    ``clip_state_at`` resolves (hue in degrees) and the picture's width and height.
    An effect's parameters only exist for pictures that have it switched on.
    """
    keys = list(keys)
    colour = state.where("color_enabled").select(
        *keys, "brightness", "contrast", "saturation", F.radians("hue").alias("hue_shift")
    )
    out = grade_enabled(pixels, colour, keys)
    out = blur(out, state.where("blur_enabled"), keys)
    out = sharpen(out, state.where("sharpen_enabled"), keys)
    shade = state.where("vignette_enabled").select(
        *keys, "width", "height",
        *[F.col(f"vignette_{n}").alias(n) for n in ("intensity", "radius", "softness", "roundness")],
    )
    out = vignette(out, shade, keys)
    return chroma_key(out, key_params(state.where("chroma_key_enabled")), keys)


def grade_enabled(pixels: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``grade`` that leaves pictures without a state row exactly as they are."""
    keys = list(keys)
    on = state.select(*keys, F.lit(True).alias("__on"))
    kept = pixels.withColumns({f"__{c}": F.col(c) for c in "rgb"})
    out = grade(kept, state, keys).join(on, keys, "left")
    flag = F.col("__on").isNotNull()
    return _keep(out.withColumns({c: F.when(flag, F.col(c)).otherwise(F.col(f"__{c}")) for c in "rgb"}), pixels)


class CustomEffect(NamedTuple):
    """A user's effect: ``lines`` is None for one on columns, else the axis along which lines run."""

    fn: Callable
    lines: str | None


CUSTOM_EFFECTS: dict[str, CustomEffect] = {}


def register_effect(name: str, fn: Callable, lines: str | None = None) -> None:
    """Make a custom effect available by name.

    Without ``lines`` it is a plan: ``fn(pixels, params) -> pixels``. With ``lines`` 'x' or 'y' it
    is run on whole picture lines, in order along that axis: ``fn(line, params) -> line``,
    where a line is a dict of equally long arrays r, g, b and a, and params a dict of the
    picture's row. The function itself goes to the workers, which know no names.
    """
    if lines not in (None, "x", "y"):
        raise ValueError(f"no axis {lines!r}")
    CUSTOM_EFFECTS[name] = CustomEffect(fn, lines)


def apply_effect(name: str, pixels: DataFrame, params: DataFrame, picture: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Run a registered effect; an unknown name changes nothing.

    ``params`` has the ``picture`` columns and one row per picture at most; a line effect
    leaves pictures without one alone.
    """
    effect = CUSTOM_EFFECTS.get(name)
    if effect is None:
        return pixels
    if effect.lines is None:
        return _keep(effect.fn(pixels, params), pixels)
    fn, names = effect.fn, [c for c in params.columns if c not in picture]
    with_params = params.select(*picture, F.struct(*names).alias("__params") if names else F.struct(F.lit(True).alias("on")).alias("__params"))

    def change(t: pa.Table, first: np.ndarray) -> pa.Table:
        columns = {c: np.array(t[c].to_numpy(), copy=True) for c in "rgba"}
        held = t["__params"]
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
            values = held[lo].as_py()
            if values is None:
                continue
            made = fn({c: v[lo:hi] for c, v in columns.items()}, values)
            for c, v in made.items():
                columns[c][lo:hi] = v
        for c, v in columns.items():
            t = t.set_column(t.column_names.index(c), c, pa.array(v, t.schema.field(c).type))
        return t

    return _keep(map_lines(pixels.join(with_params, list(picture), "left"), change, effect.lines, picture), pixels)
