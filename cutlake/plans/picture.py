"""Queries: pixel-table operators (p*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.functions import colour as cx
from cutlake.functions.arith import rounded
from cutlake.operators import pixels as px
from cutlake.plans.joining import OTHER, other_render
from cutlake.plans.registry import NUDGE, REGISTRY, Lib

q = REGISTRY.add


def out(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    cols = cols or ("r", "g", "b", "a")
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[rounded(F.col(c) + NUDGE, digits).alias(c) for c in cols])


def rnd(expr: str, name: str, digits: int = 9) -> str:
    return f'(round(({expr}) + {NUDGE!r}, {digits}) + 0.0e0) AS "{name}"'


def shown(r: str, g: str, b: str, a: str = "a") -> str:
    return ", ".join(["frame_id", "x", "y", rnd(r, "r"), rnd(g, "g"), rnd(b, "b"), rnd(a, "a")])


def clip01(e: str) -> str:
    return f"least(greatest({e}, 0), 1)"


# --- YUV ---------------------------------------------------------------------

_PROFILE = (
    "CASE vec_id % 3 WHEN 0 THEN 'Bt601' WHEN 1 THEN 'Bt709' ELSE 'Bt2020' END AS matrix",
    "CASE WHEN vec_id % 2 = 0 THEN 'Full' ELSE 'Limited' END AS range",
    "CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 10 WHEN 3 THEN 12 ELSE 10 END AS bit_depth",
    "vec_id % 4 = 1 AS semi_planar",
)
_PROFILES = (
    f"prof AS (SELECT vec_id AS frame_id, {', '.join(c.replace('AS range', 'AS rng') for c in _PROFILE)} FROM embeddings), "
    "co AS (SELECT *, 1 - kr - kb AS kg, CASE WHEN d <= 8 THEN 1 WHEN semi_planar THEN 65535e0 / (top * 2 ** (16 - d)) ELSE 65535e0 / top END AS ss, CASE WHEN rng = 'Full' THEN 0 ELSE 16 * st / top END AS lo, "
    "CASE WHEN rng = 'Full' THEN 1 ELSE 219 * st / top END AS ls, 128 * st / top AS co, CASE WHEN rng = 'Full' THEN 1 ELSE 224 * st / top END AS cs FROM "
    "(SELECT *, 2e0 ** d - 1 AS top, 2e0 ** (d - 8) AS st, CASE matrix WHEN 'Bt601' THEN 0.299e0 WHEN 'Bt2020' THEN 0.2627e0 ELSE 0.2126e0 END AS kr, CASE matrix WHEN 'Bt601' THEN 0.114e0 WHEN 'Bt2020' THEN 0.0593e0 ELSE 0.0722e0 END AS kb "
    "FROM (SELECT *, CASE WHEN bit_depth = 0 THEN 8 ELSE bit_depth END AS d FROM prof)))"
)


def profiles(lib: Lib) -> DataFrame:
    return lib.raw("embeddings").selectExpr("vec_id AS frame_id", *_PROFILE)


_CHROMA = (
    "chroma AS (SELECT vec_id AS frame_id, i % 4 AS cx, i // 4 AS cy, round(abs(CAST(embedding[i + 1] AS DOUBLE)), 5) AS cb, round(abs(CAST(embedding[i + 9] AS DOUBLE)), 5) AS cr FROM (SELECT *, unnest(range(8)) AS i FROM embeddings))"
)


@q("p1_yuv_to_rgb", "pixels",
   "SELECT frame_id, x, y, " + ", ".join([
       rnd("yy + 2 * (1 - kr) * v", "r", 5), rnd("yy - 2 * kr * (1 - kr) / kg * v - 2 * kb * (1 - kb) / kg * u", "g", 5), rnd("yy + 2 * (1 - kb) * u", "b", 5)])
   + " FROM (SELECT p.frame_id, p.x, p.y, kr, kg, kb, (p.r * ss - lo) / ls AS yy, (c.cb * ss - co) / cs AS u, (c.cr * ss - co) / cs AS v FROM pixels p JOIN co USING (frame_id) JOIN chroma c ON c.frame_id = p.frame_id AND c.cx = least(p.x // 2, 3) AND c.cy = least(p.y // 2, 1))",
   f"{_PROFILES}, {_CHROMA}")
def _(lib):
    chroma = lib.raw("embeddings").selectExpr("vec_id AS frame_id", "embedding", "explode(sequence(0, 7)) AS i").selectExpr(
        "frame_id", "i % 4 AS cx", "i div 4 AS cy", "round(abs(cast(embedding[i] AS double)), 5) AS cb",
        "round(abs(cast(embedding[i + 8] AS double)), 5) AS cr",
    )
    prof = profiles(lib).selectExpr("*", "4 AS chroma_w", "2 AS chroma_h")
    luma = lib.pixels.selectExpr("frame_id", "x", "y", "r AS v")
    return out(px.yuv_to_rgb(luma, chroma, prof), "r", "g", "b", digits=5)


_YUV = (
    "yuv AS (SELECT frame_id, x, y, l * ls + lo AS yy, (b - l) / (2 * (1 - kb)) * cs + co AS cb, (r - l) / (2 * (1 - kr)) * cs + co AS cr FROM (SELECT *, kr * r + kg * g + kb * b AS l FROM "
    "(SELECT frame_id, x, y, " + ", ".join(f"{clip01(c)} AS {c}" for c in "rgb") + " FROM {src}) JOIN co USING (frame_id)))"
)


@q("p1_rgb_to_yuv", "pixels",
   f"SELECT frame_id, x, y, {rnd('yy', 'yy')}, {rnd('cb', 'cb')}, {rnd('cr', 'cr')} FROM yuv", f"{_PROFILES}, {_YUV.format(src='pixels')}")
def _(lib):
    o = px.rgb_to_yuv(lib.pixels, profiles(lib)).select("frame_id", "x", "y", "yy", "cb", "cr")
    return out(o, "yy", "cb", "cr")


@q("p2_quantise", "pixels", "SELECT frame_id, x, y, CAST(floor(r * 255 + 0.5e0) AS INTEGER) AS code FROM pixels")
def _(lib):
    return lib.pixels.select("frame_id", "x", "y", cx.to_code8(F.col("r")).alias("code"))


@q("p3_subsample_420", "pixels",
   "SELECT frame_id, cx, cy, CAST(floor(" + clip01("cb") + " * 255 + 0.5e0) AS INTEGER) AS cb, CAST(floor(" + clip01("cr") + " * 255 + 0.5e0) AS INTEGER) AS cr FROM (SELECT frame_id, CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy, cb, cr FROM yuv)",
   f"{_PROFILES}, blk AS (SELECT frame_id, x // 2 AS x, y // 2 AS y, " + ", ".join(f"avg({clip01(c)}) AS {c}" for c in "rgb") + f" FROM pixels GROUP BY 1, 2, 3), {_YUV.format(src='blk')}")
def _(lib):
    return px.subsample_420(lib.pixels, profiles(lib))


# --- colour conversion -------------------------------------------------------

_CLIPS = (
    "vec_id AS frame_id", "vec_id % 4 AS job_id",
    "CASE vec_id % 5 WHEN 0 THEN 'Pq' WHEN 1 THEN 'Hlg' WHEN 2 THEN 'Linear' WHEN 3 THEN 'Srgb' ELSE 'Bt709' END AS transfer_fn",
    "CASE WHEN vec_id % 3 = 0 THEN 'Bt2020' ELSE 'Bt709' END AS primaries",
)
_OUTS = (
    "job_id", "CASE job_id WHEN 0 THEN 'Pq' WHEN 1 THEN 'Hlg' ELSE 'Bt709' END AS out_transfer",
    "CASE WHEN job_id = 2 THEN 'Bt2020' ELSE 'Bt709' END AS out_primaries", "CASE WHEN job_id = 0 THEN 4000e0 END AS peak_nits",
)


def _pq(n: str) -> str:
    m1, m2, c1, c2, c3 = (repr(v) for v in (1 / cx.PQ_M1, 1 / cx.PQ_M2, cx.PQ_C1, cx.PQ_C2, cx.PQ_C3))
    p = f"(greatest({n}, 0) ** {m2})"
    return f"CASE WHEN {n} <= 0 THEN 0 WHEN {c2} - {c3} * {p} <= 0 THEN 10000 ELSE (greatest({p} - {c1}, 0) / ({c2} - {c3} * {p})) ** {m1} * 10000 END"


def _pq_inv(v: str) -> str:
    y = f"(least(greatest({v} / 10000, 0), 1) ** {cx.PQ_M1!r})"
    return f"CASE WHEN {v} <= 0 THEN 0 ELSE (({cx.PQ_C1!r} + {cx.PQ_C2!r} * {y}) / (1 + {cx.PQ_C3!r} * {y})) ** {cx.PQ_M2!r} END"


def _hlg(e: str) -> str:
    return f"CASE WHEN {e} <= 0.5e0 THEN greatest({e}, 0) * greatest({e}, 0) / 3 ELSE (exp(({e} - {cx.HLG_C!r}) / {cx.HLG_A!r}) + {cx.HLG_B!r}) / 12 END"


def _hlg_inv(x: str) -> str:
    return f"CASE WHEN {x} <= {1 / 12!r} THEN sqrt(3 * greatest({x}, 0)) ELSE {cx.HLG_A!r} * ln(12 * {x} - {cx.HLG_B!r}) + {cx.HLG_C!r} END"


def _srgb(e: str) -> str:
    return f"CASE WHEN {clip01(e)} <= 0.04045e0 THEN {clip01(e)} / 12.92e0 ELSE (({clip01(e)} + 0.055e0) / 1.055e0) ** 2.4e0 END"


def _srgb_inv(x: str) -> str:
    return f"CASE WHEN {clip01(x)} <= 0.0031308e0 THEN {clip01(x)} * 12.92e0 ELSE 1.055e0 * {clip01(x)} ** {1 / 2.4!r} - 0.055e0 END"


def _each(fn) -> str:
    return ", ".join(f"{fn(c)} AS {c}" for c in "rgb")


def _mat(rows, i: int) -> str:
    return " + ".join(f"{c} * ({m!r})" for c, m in zip("rgb", rows[i]))


_CONVERT = (
    f"cl AS (SELECT {', '.join(_CLIPS)} FROM embeddings), jb AS (SELECT {', '.join(_OUTS)} FROM (SELECT DISTINCT job_id FROM cl)), "
    "pm AS (SELECT frame_id, transfer_fn AS t, out_transfer IN ('Pq','Hlg') AS hdr, out_transfer AS o, CASE WHEN primaries = 'Bt2020' AND out_primaries = 'Bt709' THEN 1 WHEN primaries = 'Bt709' AND out_primaries = 'Bt2020' THEN 2 ELSE 0 END AS gm, "
    "CASE WHEN out_transfer IN ('Pq','Hlg') THEN coalesce(peak_nits, 1000) ELSE 1000 END AS pk FROM cl JOIN jb USING (job_id)), "
    "s0 AS (SELECT p.*, t, hdr, o, gm, pk, hdr OR t IN ('Pq','Hlg') OR gm > 0 AS act FROM pixels p JOIN pm USING (frame_id)), "
    "s1 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN t = 'Pq' THEN {_pq(c)} / 100 WHEN t = 'Hlg' THEN ({_hlg(c)}) * (pk / 100) WHEN t = 'Linear' THEN {c} ELSE {_srgb(c)} END") + ") FROM s0 WHERE act), "
    "s2 AS (SELECT * REPLACE (" + ", ".join(f"CASE gm WHEN 1 THEN {_mat(cx.TO_709, i)} WHEN 2 THEN {_mat(cx.TO_2020, i)} ELSE {c} END AS {c}" for i, c in enumerate("rgb")) + ") FROM s1), "
    "s3 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN hdr THEN greatest({c}, 0) ELSE " + clip01(f"(greatest({c}, 0) * (greatest({c}, 0) * 2.51e0 + 0.03e0)) / (greatest({c}, 0) * (greatest({c}, 0) * 2.43e0 + 0.59e0) + 0.14e0)") + " END") + ") FROM s2), "
    "s4 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN o = 'Pq' THEN {_pq_inv(f'({c} * 100)')} WHEN o = 'Hlg' THEN " + _hlg_inv(clip01(f"({c} * (100 / pk))")) + f" ELSE {_srgb_inv(c)} END") + ") FROM s3 UNION ALL SELECT * FROM s0 WHERE NOT act)"
)


@q("p4_convert_color", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM s4", _CONVERT)
def _(lib):
    clips = lib.raw("embeddings").selectExpr(*_CLIPS)
    jobs = clips.select("job_id").distinct().selectExpr(*_OUTS)
    return out(px.convert_color(lib.pixels, px.conversion_params(clips, jobs)))


# --- grade, key, vignette, stencils ------------------------------------------

_GRADE = (
    "vec_id AS frame_id", "(vec_id % 5 - 2) / 20e0 AS lift_r", "(vec_id % 3) / 10e0 AS lift_b", "1 + (vec_id % 4) / 4e0 AS gamma_g", "CASE WHEN vec_id % 6 = 5 THEN 0e0 ELSE 1e0 END AS gamma_b",
    "1 + (vec_id % 7 - 3) / 10e0 AS gain_r", "CASE WHEN vec_id % 4 = 0 THEN 1e0 ELSE (vec_id % 4) / 2e0 END AS saturation", "(vec_id % 3 - 1) / 20e0 AS brightness", "1 + (vec_id % 5 - 2) / 5e0 AS contrast", "(vec_id % 4) / 3e0 AS hue_shift",
)


def _grade_sql(src: str, state: str) -> str:
    k0, k1, k2 = (repr(k) for k in cx.LUMA)
    d, co, si = "(1 - cos(hue_shift))", "cos(hue_shift)", "sin(hue_shift)"
    hue = [
        f"r * ({co} + {d} * {k0}) + g * ({k0} * {d} - {k2} * {si}) + b * ({k0} * {d} + {k1} * {si})",
        f"r * ({k1} * {d} + {k2} * {si}) + g * ({co} + {d} * {k1}) + b * ({k1} * {d} - {k0} * {si})",
        f"r * ({k2} * {d} - {k1} * {si}) + g * ({k2} * {d} + {k0} * {si}) + b * ({co} + {d} * {k2})",
    ]
    return (
        f"g0 AS (SELECT * FROM {src} JOIN {state} USING (frame_id)), "
        "g1 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN gamma_{c} > 0 THEN greatest({c} + lift_{c} * (1 - {c}), 0) ** (1 / gamma_{c}) ELSE {c} + lift_{c} * (1 - {c}) END * gain_{c}") + ") FROM g0), "
        "g2 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN abs(contrast - 1) > 0.001e0 OR abs(brightness) > 0.001e0 THEN greatest(({c} - 0.5e0) * greatest(contrast, 0) + 0.5e0 + brightness, 0) ELSE {c} END") + ") FROM g1), "
        f"g3 AS (SELECT * EXCLUDE (yl) REPLACE (" + _each(lambda c: f"CASE WHEN abs(saturation - 1) > 0.001e0 THEN greatest(yl * (1 - greatest(saturation, 0)) + {c} * greatest(saturation, 0), 0) ELSE {c} END") + f") FROM (SELECT *, r * {k0} + g * {k1} + b * {k2} AS yl FROM g2)), "
        "g4 AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN abs(hue_shift) > 0.001e0 THEN greatest({h}, 0) ELSE {c} END AS {c}" for h, c in zip(hue, "rgb")) + ") FROM g3)"
    )


@q("p5_grade", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM g4",
   f"gs AS (SELECT {', '.join(_GRADE)}, 0e0 AS lift_g, 1e0 AS gamma_r, 1e0 AS gain_g, 1e0 AS gain_b FROM embeddings), " + _grade_sql("pixels", "gs"))
def _(lib):
    return out(px.grade(lib.pixels, lib.raw("embeddings").selectExpr(*_GRADE)))


_LUTS = (
    "luts AS (SELECT concat('L', CAST(vec_id AS VARCHAR)) AS lut_id, CAST(i % 3 AS INTEGER) AS ri, CAST(i // 3 % 3 AS INTEGER) AS gi, CAST(i // 9 AS INTEGER) AS bi, "
    "CAST(embedding[i + 1] AS DOUBLE) AS lr, CAST(embedding[i + 20] AS DOUBLE) AS lg, CAST(embedding[i + 37] AS DOUBLE) AS lb FROM (SELECT *, unnest(range(27)) AS i FROM embeddings)), "
    "us AS (SELECT vec_id AS frame_id, concat('L', CAST(CASE WHEN vec_id % 8 = 7 THEN vec_id + 1000000000 ELSE vec_id // 2 END AS VARCHAR)) AS lut_id, (vec_id % 5) / 4e0 AS strength FROM embeddings), "
    "ps AS (SELECT p.*, lut_id, strength, " + ", ".join(f"{clip01(c)} * 2 AS {c}p, least(CAST(floor({clip01(c)} * 2) AS INTEGER), 1) AS {c}0" for c in "rgb") + " FROM pixels p JOIN us USING (frame_id)), "
    "lk AS (SELECT frame_id, x, y, any_value(ps.r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(a) AS a, any_value(strength) AS s, count(lr) AS hit, "
    + ", ".join(f"sum(l{c} * w) AS v{c}" for c in "rgb")
    + " FROM (SELECT ps.*, l.*, (CASE WHEN ri = r0 THEN 1 - (rp - r0) ELSE rp - r0 END) * (CASE WHEN gi = g0 THEN 1 - (gp - g0) ELSE gp - g0 END) * (CASE WHEN bi = b0 THEN 1 - (bp - b0) ELSE bp - b0 END) AS w "
    "FROM ps LEFT JOIN luts l ON l.lut_id = ps.lut_id AND ri IN (r0, r0 + 1) AND gi IN (g0, g0 + 1) AND bi IN (b0, b0 + 1)) ps GROUP BY 1, 2, 3)"
)


@q("p6_apply_lut", "pixels", "SELECT " + shown(*[f"CASE WHEN hit > 0 THEN {c} + (v{c} - {c}) * s ELSE {c} END" for c in "rgb"]) + " FROM lk", _LUTS)
def _(lib):
    e = lib.raw("embeddings")
    luts = e.selectExpr("vec_id", "embedding", "explode(sequence(0, 26)) AS i").selectExpr(
        "concat('L', vec_id) AS lut_id", "3 AS size", "cast(i % 3 AS int) AS ri", "cast(i div 3 % 3 AS int) AS gi", "cast(i div 9 AS int) AS bi",
        "cast(embedding[i] AS double) AS r", "cast(embedding[i + 19] AS double) AS g", "cast(embedding[i + 36] AS double) AS b",
    )
    use = e.selectExpr(
        "vec_id AS frame_id", "concat('L', CASE WHEN vec_id % 8 = 7 THEN vec_id + 1000000000 ELSE vec_id div 2 END) AS lut_id", "(vec_id % 5) / 4e0 AS strength"
    )
    return out(px.apply_lut(lib.pixels, use, luts))


_KEY = (
    "vec_id AS frame_id", "(vec_id % 12) * 30e0 AS key_hue", "20 + (vec_id % 5) * 15e0 AS tolerance", "(vec_id % 3) * 8e0 AS softness", "0.08e0 AS min_saturation", "0.05e0 AS min_value", "(vec_id % 4) / 3e0 AS spill_suppress",
)


def _key_sql(src: str, state: str) -> str:
    six = "((((g - b) / d) % 6 + 6) % 6)"
    hue = f"CASE WHEN d < 0.0001e0 THEN 0 WHEN v = r THEN 60 * {six} WHEN v = g THEN ((b - r) / d + 2) * 60 ELSE ((r - g) / d + 4) * 60 END"
    return (
        f"k0 AS (SELECT *, v - n AS d FROM (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS n FROM {src} JOIN {state} USING (frame_id))), "
        f"k1 AS (SELECT *, least(abs(h - key_hue), 360 - abs(h - key_hue)) AS ds, CASE WHEN v > 0.0001e0 THEN d / v ELSE 0 END AS sa FROM (SELECT *, {hue} AS h FROM k0)), "
        f"k2 AS (SELECT *, CASE WHEN sa > min_saturation AND v > min_value THEN t * t * (3 - t * 2) ELSE 0 END AS m FROM (SELECT *, {clip01('(tolerance - ds) / greatest(softness, 0.0001e0)')} AS t FROM k1)), "
        "k3 AS (SELECT *, spill_suppress * m AS pt, key_hue > 60 AND key_hue < 180 AS gr FROM k2), "
        "k4 AS (SELECT * REPLACE (CASE WHEN pt > 0 AND gr THEN g * (1 - pt) + least(g, (r + b) / 2) * pt ELSE g END AS g, CASE WHEN pt > 0 AND NOT gr THEN b * (1 - pt) + least(b, (r + g) / 2) * pt ELSE b END AS b, a * (1 - m) AS a) FROM k3)"
    )


@q("p7_chroma_key", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM k4", f"ks AS (SELECT {', '.join(_KEY)} FROM embeddings), " + _key_sql("pixels", "ks"))
def _(lib):
    return out(px.chroma_key(lib.pixels, lib.raw("embeddings").selectExpr(*_KEY)))


_VIG = (
    "vec_id AS frame_id", "(vec_id % 5) / 4e0 AS intensity", "0.3e0 + (vec_id % 4) / 5e0 AS radius", "0.2e0 + (vec_id % 3) / 5e0 AS softness", "(vec_id % 3) / 2e0 AS roundness", "7 AS width", "3 AS height",
)


def _vig_sql(src: str, state: str) -> str:
    dist = (
        "sqrt(dx * dx + dy * dy) * 2 * (1 - roundness) + sqrt(dx * asp * dx * asp + dy * dy) * 2 / asp * roundness"
    )
    return (
        f"v0 AS (SELECT *, x / width - 0.5e0 AS dx, y / height - 0.5e0 AS dy, width / greatest(height, 1) AS asp, greatest(radius - softness, 0) AS inn FROM {src} JOIN {state} USING (frame_id)), "
        f"v1 AS (SELECT *, {clip01(f'({dist} - inn) / (radius + softness - inn)')} AS t FROM v0), "
        f"v2 AS (SELECT * REPLACE (" + _each(lambda c: f"{c} * CASE WHEN intensity > 0.001e0 THEN {clip01('1 - t * t * (3 - t * 2) * intensity')} ELSE 1 END") + ") FROM v1)"
    )


@q("p8_vignette", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM v2", f"vs AS (SELECT {', '.join(_VIG)} FROM embeddings), " + _vig_sql("pixels", "vs"))
def _(lib):
    return out(px.vignette(lib.pixels, lib.raw("embeddings").selectExpr(*_VIG)))


def _blur_sql(src: str, state: str) -> str:
    def one(name: str, frm: str, axis: str, top: int) -> str:
        across = "y" if axis == "x" else "x"
        return (
            f"{name} AS (SELECT p.frame_id, p.x, p.y, " + ", ".join(f"sum(n.{c} * w) / sum(w) AS {c}" for c in "rgba")
            + f" FROM {frm} p JOIN wt USING (frame_id) JOIN {frm} n ON n.frame_id = p.frame_id AND n.{across} = p.{across} AND n.{axis} = least(greatest(p.{axis} + wt.i, 0), {top}) GROUP BY 1, 2, 3)"
        )

    return (
        f"wt AS (SELECT frame_id, i, exp(-(i * i) / (2 * greatest(blur_sigma, 0.5e0) * greatest(blur_sigma, 0.5e0))) AS w FROM (SELECT *, unnest(range(-rr, rr + 1)) AS i FROM (SELECT *, CAST(floor(least(greatest(blur_radius, 1), 64)) AS BIGINT) AS rr FROM {state}))), "
        + one("b1", src, "x", 6) + ", " + one("b2", "b1", "y", 2)
    )


_BLUR = ("vec_id AS frame_id", "(vec_id % 4) * 1.3e0 AS blur_radius", "(vec_id % 5) / 2e0 AS blur_sigma")


@q("p9_blur", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM b2", f"bs AS (SELECT {', '.join(_BLUR)} FROM embeddings), " + _blur_sql("pixels", "bs"))
def _(lib):
    return out(px.blur(lib.pixels, lib.raw("embeddings").selectExpr(*_BLUR)))


def _sharp_sql(src: str, state: str) -> str:
    def near(c: str) -> str:
        h, v = "OVER (PARTITION BY frame_id, y ORDER BY x)", "OVER (PARTITION BY frame_id, x ORDER BY y)"
        return f"(coalesce(lag({c}) {h}, {c}) + coalesce(lead({c}) {h}, {c}) + coalesce(lag({c}) {v}, {c}) + coalesce(lead({c}) {v}, {c})) * 0.25e0 AS n{c}"

    return (
        f"h0 AS (SELECT *, {', '.join(near(c) for c in 'rgb')} FROM {src} JOIN {state} USING (frame_id)), "
        "h1 AS (SELECT * REPLACE (" + _each(lambda c: f"CASE WHEN sharpen_amount > 0.001e0 THEN greatest({c} + ({c} - n{c}) * sharpen_amount, 0) ELSE {c} END") + ") FROM h0)"
    )


@q("p9_sharpen", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM h1", "hs AS (SELECT vec_id AS frame_id, (vec_id % 5) / 3e0 AS sharpen_amount FROM embeddings), " + _sharp_sql("pixels", "hs"))
def _(lib):
    return out(px.sharpen(lib.pixels, lib.raw("embeddings").selectExpr("vec_id AS frame_id", "(vec_id % 5) / 3e0 AS sharpen_amount")))


# --- masks, mattes, compositing ----------------------------------------------

_TRI = ((0.1, 0.05), (0.95, 0.3), (0.4, 0.98), (0.35, 0.45))


def _mask_sql() -> str:
    edges = []
    for i, (x, y) in enumerate(_TRI):
        bx, by = _TRI[i - 1]
        edges.append(f"CASE WHEN ({y!r} > v) <> ({by!r} > v) AND u < ({bx!r} - {x!r}) * (v - {y!r}) / ({by!r} - {y!r}) + {x!r} THEN 1 ELSE 0 END")
    poly = f"CASE WHEN ({' + '.join(edges)}) % 2 = 1 THEN 1e0 ELSE 0e0 END"

    def ramp(d: str) -> str:
        return clip01(f"({d}) / (f * 0.5e0)")

    rect = (
        "CASE WHEN f < 1e-7 THEN CASE WHEN u BETWEEN 0.2e0 AND 0.8e0 AND v BETWEEN 0.1e0 AND 0.9e0 THEN 1e0 ELSE 0e0 END ELSE "
        f"least({ramp('u - 0.2e0')}, {ramp('0.8e0 - u')}, {ramp('v - 0.1e0')}, {ramp('0.9e0 - v')}) END"
    )
    dist = "sqrt(((u - 0.5e0) / rx) * ((u - 0.5e0) / rx) + ((v - 0.4e0) / 0.5e0) * ((v - 0.4e0) / 0.5e0))"
    ell = f"CASE WHEN rx <= 0 THEN 0 WHEN f < 1e-7 THEN CASE WHEN {dist} <= 1 THEN 1e0 ELSE 0e0 END ELSE {clip01(f'(1 + f * 0.5e0 - {dist}) / f')} END"
    return f"CASE frame_id % 5 WHEN 0 THEN {rect} WHEN 1 THEN {ell} WHEN 2 THEN {poly} ELSE 1 END"


@q("p10_mask", "pixels",
   f"SELECT frame_id, x, y, {rnd(f'a * {_mask_sql()}', 'a')} FROM (SELECT *, (x + 0.5e0) / 7 AS u, (y + 0.5e0) / 3 AS v, (frame_id % 4) / 5e0 AS f, CASE WHEN frame_id % 3 = 0 THEN 0e0 ELSE 0.3e0 END AS rx FROM pixels)")
def _(lib):
    masks = lib.raw("embeddings").selectExpr(
        "vec_id AS frame_id",
        "CASE vec_id % 5 WHEN 0 THEN 'Rectangle' WHEN 1 THEN 'Ellipse' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'Polygon' ELSE 'None' END AS kind",
        "named_struct('left', 0.2e0, 'top', 0.1e0, 'right', 0.8e0, 'bottom', 0.9e0, 'feather', (vec_id % 4) / 5e0) AS rect",
        "named_struct('cx', 0.5e0, 'cy', 0.4e0, 'rx', CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE 0.3e0 END, 'ry', 0.5e0, 'feather', (vec_id % 4) / 5e0) AS ellipse",
        "slice(array(" + ", ".join(f"named_struct('x', {x}e0, 'y', {y}e0)" for x, y in _TRI) + "), 1, CASE WHEN vec_id % 5 = 3 THEN 2 ELSE 4 END) AS points",
    )
    p = lib.pixels.selectExpr("*", "(x + 0.5e0) / 7 AS u", "(y + 0.5e0) / 3 AS v")
    return out(px.mask(p, masks).select("frame_id", "x", "y", "a"), "a")


_MODES = "['None', 'AlphaMatte', 'AlphaMatteInverted', 'LumaMatte', 'LumaMatteInverted']"


@q("p11_matte", "pixels",
   f"SELECT l.frame_id, l.x, l.y, {rnd('l.a * CASE WHEN m.a IS NULL THEN 1 ELSE CASE l.frame_id % 5 WHEN 1 THEN ' + clip01('m.a') + ' WHEN 2 THEN ' + clip01('1 - m.a') + ' WHEN 3 THEN ' + clip01('m.r * 0.2126e0 + m.g * 0.7152e0 + m.b * 0.0722e0') + ' WHEN 4 THEN ' + clip01('1 - (m.r * 0.2126e0 + m.g * 0.7152e0 + m.b * 0.0722e0)') + ' ELSE 1 END END', 'a')} "
   "FROM pixels l LEFT JOIN pixels m ON m.frame_id = l.frame_id + 1 AND m.x = l.x AND m.y = l.y")
def _(lib):
    layers = lib.pixels.selectExpr(
        "*", "element_at(array('None', 'AlphaMatte', 'AlphaMatteInverted', 'LumaMatte', 'LumaMatteInverted'), cast(frame_id % 5 + 1 AS int)) AS matte_mode", "1 AS matte_id"
    )
    mattes = lib.pixels.selectExpr("1 AS matte_id", "frame_id - 1 AS frame_id", "x", "y", "r", "g", "b", "a")
    return out(px.matte(layers, mattes).select("frame_id", "x", "y", "a"), "a")


_MODE_LIST = list(cx.BLENDS)


def _blend_sql(s: str, d: str) -> str:
    inv = f"(1 - (1 - {s}) * (1 - {d}) * 2)"
    cases = {
        "Add": f"least({s} + {d}, 1)", "Multiply": f"{s} * {d}", "Screen": f"1 - (1 - {s}) * (1 - {d})",
        "Overlay": f"CASE WHEN {d} < 0.5e0 THEN {s} * {d} * 2 ELSE {inv} END", "Darken": f"least({s}, {d})", "Lighten": f"greatest({s}, {d})",
        "ColorDodge": f"CASE WHEN {s} >= 1 THEN 1 ELSE least({d} / (1 - {s}), 1) END", "ColorBurn": f"CASE WHEN {s} <= 0 THEN 0 ELSE greatest(1 - (1 - {d}) / {s}, 0) END",
        "HardLight": f"CASE WHEN {s} < 0.5e0 THEN {s} * {d} * 2 ELSE {inv} END", "SoftLight": f"(1 - {s} * 2) * {d} * {d} + {s} * {d} * 2",
        "Difference": f"abs({s} - {d})", "Exclusion": f"{s} + {d} - {s} * {d} * 2",
    }
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {e}" for m, e in cases.items()) + f" ELSE {s} END"


# Two layers per pixel: neighbouring pictures, the even one below.
_LAYERS = (
    "ly AS (SELECT frame_id // 2 AS frame_id, x, y, frame_id % 2 AS layer_order, ['" + "', '".join(_MODE_LIST) + "'][CAST(frame_id // 2 % 13 + 1 AS INTEGER)] AS mode, " + ", ".join(f"{clip01(c)} AS {c}" for c in "rgb") + ", CASE WHEN frame_id % 9 = 8 THEN 0 ELSE a END AS a FROM pixels), "
    "c0 AS (SELECT t.frame_id, t.x, t.y, t.mode, t.r AS sr, t.g AS sg, t.b AS sb, t.a AS sa, u.r AS dr, u.g AS dg, u.b AS db, u.a AS da FROM ly t JOIN ly u ON u.frame_id = t.frame_id AND u.x = t.x AND u.y = t.y AND u.layer_order = 0 WHERE t.layer_order = 1), "
    "c1 AS (SELECT * REPLACE (CASE WHEN da > 1e-7 THEN dr ELSE 0 END AS dr, CASE WHEN da > 1e-7 THEN dg ELSE 0 END AS dg, CASE WHEN da > 1e-7 THEN db ELSE 0 END AS db), sa + da * (1 - sa) AS oa FROM c0), "
    "c2 AS (SELECT frame_id, x, y, oa, " + ", ".join(f"CASE WHEN oa > 1e-7 THEN (sa * (1 - da) * s{c} + da * (1 - sa) * d{c} + sa * da * ({_blend_sql(f's{c}', f'd{c}')})) / oa ELSE 0 END AS {c}" for c in "rgb") + " FROM c1)"
)


def layers(lib: Lib) -> DataFrame:
    modes = ", ".join(f"'{m}'" for m in _MODE_LIST)
    return lib.pixels.selectExpr(
        "frame_id div 2 AS frame_id", "x", "y", "frame_id % 2 AS layer_order", "frame_id AS clip_id",
        f"element_at(array({modes}), cast(frame_id div 2 % 13 + 1 AS int)) AS blend_mode",
        *[f"least(greatest({c}, 0e0), 1e0) AS {c}" for c in "rgb"], "CASE WHEN frame_id % 9 = 8 THEN 0e0 ELSE a END AS a",
    )


@q("p13_composite", "pixels", f"SELECT {shown('r', 'g', 'b', 'CASE WHEN oa > 1e-7 THEN oa ELSE 0 END')} FROM c2", _LAYERS)
def _(lib):
    return out(px.composite(layers(lib)))


@q("p12_blend_channel", "pixels",
   f"SELECT frame_id, x, y, {rnd(_blend_sql('s', 'd'), 'mixed')} FROM (SELECT *, {clip01('r')} AS s, {clip01('g')} AS d, ['" + "', '".join(_MODE_LIST) + "'][CAST(frame_id % 13 + 1 AS INTEGER)] AS mode FROM pixels)")
def _(lib):
    modes = ", ".join(f"'{m}'" for m in _MODE_LIST)
    p = lib.pixels.selectExpr(
        "frame_id", "x", "y", "least(greatest(r, 0e0), 1e0) AS s", "least(greatest(g, 0e0), 1e0) AS d",
        f"element_at(array({modes}), cast(frame_id % 13 + 1 AS int)) AS mode",
    )
    return p.select("frame_id", "x", "y", rounded(cx.blend_channel(F.col("mode"), F.col("s"), F.col("d")) + NUDGE, 9).alias("mixed"))


_PLACE = (
    "vec_id AS clip_id", "(vec_id % 11 - 5) * 1.7e0 AS position_x", "(vec_id % 7 - 3) * 1.3e0 AS position_y", "0.5e0 + (vec_id % 5) / 4e0 AS scale_x", "CASE WHEN vec_id % 2 = 0 THEN -0.8e0 ELSE 1.1e0 END AS scale_y",
    "(vec_id % 9) * 0.41e0 AS rotation", "0.5e0 AS anchor_x", "(vec_id % 3) / 2e0 AS anchor_y", "9e0 AS clip_w", "6e0 AS clip_h", "16 AS canvas_w", "12 AS canvas_h",
)
_PLACE_SQL = (
    f"pc AS (SELECT {', '.join(_PLACE)} FROM embeddings), "
    "gd AS (SELECT *, CAST(i % 16 AS INTEGER) AS x, CAST(i // 16 AS INTEGER) AS y FROM (SELECT *, unnest(range(192)) AS i FROM pc)), "
    "dl AS (SELECT *, (x + 0.5e0) - (position_x + canvas_w * 0.5e0) AS dx, (y + 0.5e0) - (position_y + canvas_h * 0.5e0) AS dy, cos(-rotation) AS c, sin(-rotation) AS s FROM gd), "
    "uv AS (SELECT clip_id, x, y, (dx * c + dy * s) / (scale_x * clip_w) + anchor_x AS u, (dy * c - dx * s) / (scale_y * clip_h) + anchor_y AS v FROM dl)"
)


@q("p14_place", "", f"SELECT clip_id, x, y, {rnd('u', 'u', 5)}, {rnd('v', 'v', 5)} FROM uv WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1", _PLACE_SQL)
def _(lib):
    return out(px.place(lib.raw("embeddings").selectExpr(*_PLACE)), "u", "v", digits=5)


def _lab_sql(name: str, src: str) -> str:
    def f(t: str) -> str:
        return f"CASE WHEN {t} > 0.008856e0 THEN cbrt({t}) ELSE {t} * {(29 / 6) ** 2 / 3!r} + {4 / 29!r} END"

    return (
        f"{name} AS (SELECT frame_id, x, y, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM (SELECT frame_id, x, y, {f('cx')} AS fx, {f('cy')} AS fy, {f('cz')} AS fz FROM "
        "(SELECT frame_id, x, y, (r * 0.4124564e0 + g * 0.3575761e0 + b * 0.1804375e0) / 0.95047e0 AS cx, r * 0.2126729e0 + g * 0.7151522e0 + b * 0.0721750e0 AS cy, "
        f"(r * 0.0193339e0 + g * 0.1191920e0 + b * 0.9503041e0) / 1.08883e0 AS cz FROM {src})))"
    )


_DE = (
    f"{OTHER}, {_lab_sql('la', 'pixels')}, {_lab_sql('lb', 'other')}, "
    "d0 AS (SELECT frame_id, la.l AS l1, la.a AS a1, la.b AS b1, lb.l AS l2, lb.a AS a2, lb.b AS b2, ((sqrt(la.a * la.a + la.b * la.b) + sqrt(lb.a * lb.a + lb.b * lb.b)) / 2) ** 7 AS c7 FROM la JOIN lb USING (frame_id, x, y)), "
    "d1 AS (SELECT *, a1 * (1.5e0 - 0.5e0 * sqrt(c7 / (c7 + 6103515625e0))) AS p1, a2 * (1.5e0 - 0.5e0 * sqrt(c7 / (c7 + 6103515625e0))) AS p2 FROM d0), "
    "d2 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, degrees(atan2(b1, p1)) + CASE WHEN atan2(b1, p1) < 0 THEN 360 ELSE 0 END AS h1, degrees(atan2(b2, p2)) + CASE WHEN atan2(b2, p2) < 0 THEN 360 ELSE 0 END AS h2 FROM d1), "
    "d3 AS (SELECT *, (c1 + c2) / 2 AS cm, ((l1 + l2) / 2 - 50) ** 2 AS l50, CASE WHEN c1 * c2 < 1e-12 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, "
    "CASE WHEN c1 * c2 < 1e-12 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM d2), "
    "d4 AS (SELECT frame_id, (l2 - l1) / (1 + 0.015e0 * l50 / sqrt(20 + l50)) AS tl, (c2 - c1) / (1 + 0.045e0 * cm) AS tc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015e0 * cm * (1 - 0.17e0 * cos(radians(hm - 30)) + 0.24e0 * cos(radians(2 * hm)) + 0.32e0 * cos(radians(3 * hm + 6)) - 0.20e0 * cos(radians(4 * hm - 63)))) AS th, "
    "-sin(radians(60 * exp(0 - ((hm - 275) / 25) * ((hm - 275) / 25)))) * 2 * sqrt(cm ** 7 / (cm ** 7 + 6103515625e0)) AS rt FROM d3), "
    "de AS (SELECT frame_id, sqrt(greatest(tl * tl + tc * tc + th * th + rt * tc * th, 0)) AS e FROM d4), "
    "dr AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY e) AS rn, count(*) OVER (PARTITION BY frame_id) AS n FROM de)"
)


@q("p15_delta_e", "pixels",
   f"SELECT frame_id, {rnd('avg(e)', 'mean_de', 6)}, {rnd('max(CASE WHEN rn = greatest(ceil(n * 0.95e0), 1) THEN e END)', 'p95_de', 6)}, {rnd('max(e)', 'max_de', 6)}, any_value(missing) AS missing FROM dr JOIN (SELECT frame_id, count(*) FILTER (WHERE a < 0.7e0 AND x = 3) AS missing FROM pixels GROUP BY 1) USING (frame_id) GROUP BY 1", _DE)
def _(lib):
    return out(px.delta_e(lib.pixels, other_render(lib)), "mean_de", "p95_de", "max_de", digits=6)


_STATE = (
    "vec_id AS frame_id", "vec_id % 5 < 3 AS color_enabled", "vec_id % 2 = 0 AS blur_enabled", "vec_id % 3 = 0 AS sharpen_enabled", "vec_id % 4 = 1 AS vignette_enabled", "vec_id % 3 <> 1 AS chroma_key_enabled",
    "(vec_id % 3 - 1) / 20e0 AS brightness", "1 + (vec_id % 5 - 2) / 5e0 AS contrast", "(vec_id % 4) / 2e0 AS saturation", "(vec_id % 7) * 10e0 AS hue", "(vec_id % 4) * 1.3e0 AS blur_radius", "(vec_id % 5) / 2e0 AS blur_sigma",
    "0.4e0 AS sharpen_amount", "0.7e0 AS vignette_intensity", "0.5e0 AS vignette_radius", "0.3e0 AS vignette_softness", "0.5e0 AS vignette_roundness", "7 AS width", "3 AS height",
    "0e0 AS key_r", "1e0 AS key_g", "(vec_id % 3) / 4e0 AS key_b", "0.3e0 AS chroma_key_tolerance", "0.1e0 AS chroma_key_softness", "0.08e0 AS min_saturation", "0.3e0 AS spill_suppress",
)


def _render_sql() -> str:
    """The effect chain as CTEs: every stage is the effect where on, else a pass."""

    def stage(name: str, src: str, flag: str, body: str, result: str) -> str:
        return (
            body + f", {name} AS (SELECT frame_id, x, y, r, g, b, a FROM {result} UNION ALL SELECT frame_id, x, y, r, g, b, a FROM {src} JOIN st USING (frame_id) WHERE NOT {flag})"
        )

    neutral = ", ".join(f"{v!r}::DOUBLE AS {c}" for c, v in px.NEUTRAL_GRADE.items() if c not in ("saturation", "brightness", "contrast", "hue_shift"))
    k = "CASE WHEN key_b = 0 THEN 120e0 ELSE ((key_b - key_r) / (1 - least(key_r, key_b)) + 2) * 60 END"
    return ", ".join(
        [
            f"st AS (SELECT {', '.join(_STATE)} FROM embeddings)",
            f"e1 AS (SELECT frame_id, saturation, brightness, contrast, radians(hue) AS hue_shift, {neutral} FROM st WHERE color_enabled)",
            stage("t1", "pixels", "color_enabled", _grade_sql("pixels", "e1"), "g4"),
            "e2 AS (SELECT frame_id, blur_radius, blur_sigma FROM st WHERE blur_enabled)",
            stage("t2", "t1", "blur_enabled", _blur_sql("t1", "e2"), "b2"),
            "e3 AS (SELECT frame_id, sharpen_amount FROM st WHERE sharpen_enabled)",
            stage("t3", "t2", "sharpen_enabled", _sharp_sql("t2", "e3"), "h1"),
            "e4 AS (SELECT frame_id, vignette_intensity AS intensity, vignette_radius AS radius, vignette_softness AS softness, vignette_roundness AS roundness, width, height FROM st WHERE vignette_enabled)",
            stage("t4", "t3", "vignette_enabled", _vig_sql("t3", "e4"), "v2"),
            f"e5 AS (SELECT frame_id, {k} AS key_hue, 54e0 AS tolerance, 18e0 AS softness, min_saturation, 0.05e0 AS min_value, spill_suppress FROM st WHERE chroma_key_enabled)",
            stage("t5", "t4", "chroma_key_enabled", _key_sql("t4", "e5"), "k4"),
        ]
    )


@q("p16_render_clips", "pixels", f"SELECT {shown('r', 'g', 'b')} FROM t5", _render_sql())
def _(lib):
    state = lib.raw("embeddings").selectExpr(*_STATE)
    return out(px.render_clips(lib.pixels, state, ["frame_id"]))


# --- custom effects ----------------------------------------------------------

_PRESS = ("vec_id AS frame_id", "(vec_id % 3) / 2e0 AS amount")


def press(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """A custom effect on columns: colours drawn towards the pixel's largest."""
    top = F.greatest("r", "g", "b")
    return pixels.join(params, "frame_id").withColumns({c: F.col(c) + (top - F.col(c)) * F.col("amount") for c in "rgb"})


def smear(line: dict, params: dict) -> dict:
    """A custom effect on lines: the brightest value so far, faded in by ``amount``."""
    return {c: line[c] + (np.maximum.accumulate(line[c]) - line[c]) * params["amount"] for c in "rgb"}


@q("p16_custom_column_effect", "pixels", f"SELECT {shown('r + (m - r) * amount', 'g + (m - g) * amount', 'b + (m - b) * amount')} FROM (SELECT *, greatest(r, g, b) AS m FROM pixels JOIN pr USING (frame_id))", f"pr AS (SELECT {', '.join(_PRESS)} FROM embeddings)")
def _(lib):
    px.register_effect("press", press)
    return out(px.apply_effect("press", lib.pixels, lib.raw("embeddings").selectExpr(*_PRESS)))


_SOFAR = ", ".join(f"max({c}) OVER (PARTITION BY frame_id, x ORDER BY y) AS m{c}" for c in "rgb")


@q("p16_custom_line_effect", "pixels", f"SELECT {shown('r + (mr - r) * amount', 'g + (mg - g) * amount', 'b + (mb - b) * amount')} FROM (SELECT *, {_SOFAR} FROM pixels LEFT JOIN pr USING (frame_id))",
   f"pr AS (SELECT {', '.join(_PRESS)} FROM embeddings)")
def _(lib):
    px.register_effect("smear", smear, lines="y")
    return out(px.apply_effect("smear", lib.pixels, lib.raw("embeddings").selectExpr(*_PRESS)))
