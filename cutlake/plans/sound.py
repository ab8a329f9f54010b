"""Queries: timeline audio (u*)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.operators import audio
from cutlake.plans.joining import TRACKS, half_away, pool, pool_sql, tracks
from cutlake.plans.registry import NUDGE, REGISTRY, Lib

q = REGISTRY.add


@q("u1_audible_clips", "clips jobs",
   "SELECT j.job_id, c.clip_id, round(c.volume * coalesce(t.gain, 1), 6) AS gain, round(least(greatest(c.pan + coalesce(t.pan, 0), -1), 1), 6) AS mix_pan FROM (SELECT * REPLACE (pts_in * 16 AS pts_in, pts_out * 16 AS pts_out) FROM jobs) j JOIN clips c ON j.project_id = c.project_id "
   "AND c.pts_out > j.pts_in AND c.pts_in < j.pts_out AND j.pts_in < j.pts_out LEFT JOIN (SELECT t.*, NOT mute AND (NOT s OR solo) AS act FROM trk t JOIN (SELECT project_id, bool_or(solo) AS s FROM trk GROUP BY 1) USING (project_id)) t "
   "ON t.project_id = c.project_id AND t.track_id = c.track_id WHERE EXISTS (SELECT 1 FROM pool m WHERE m.project_id = c.project_id AND m.source_id = c.source_id AND m.has_audio) AND coalesce(t.act, true)",
   f"{TRACKS}, trk AS (SELECT * FROM tracks WHERE track_id <> 3), {pool_sql('clips')}")
def _(lib):
    known = tracks(lib).where("track_id <> 3")
    jobs = lib.jobs.selectExpr("job_id", "project_id", "pts_in * 16 AS pts_in", "pts_out * 16 AS pts_out")
    out = audio.audible_clips(jobs, lib.clips, known, pool(lib.clips))
    return out.select("job_id", "clip_id", rounded(F.col("gain")).alias("gain"), rounded(F.col("mix_pan")).alias("mix_pan"))


# Short clips over the 64-sample sources: one job per fifty of them.
_AUD = (
    "vec_id // 50 AS job_id, vec_id AS source_id, 30 AS job_in, 2400 AS job_out, (vec_id % 50) * 45 AS pts_in, (vec_id % 50) * 45 + 100 AS pts_out, (vec_id % 7) * 3 AS source_in, "
    "CASE vec_id % 5 WHEN 0 THEN 0.5e0 WHEN 3 THEN 1.6e0 ELSE 1e0 END AS speed, (vec_id % 3) * 20 AS fade_in_pts, (vec_id % 4) * 15 AS fade_out_pts, 1e0 + (vec_id % 4) AS gain, "
    "((vec_id % 9) - 4) / 4e0 AS pan, ((vec_id % 3) - 1) / 2e0 AS track_pan, label = 3 AS audio_muted"
)


def placements(lib: Lib) -> DataFrame:
    cols = [c.replace("//", "div") for c in _select_list(_AUD)]
    out = lib.raw("embeddings").selectExpr(*cols)
    return out.withColumn("mix_pan", F.least(F.greatest(F.col("pan") + F.col("track_pan"), F.lit(-1.0)), F.lit(1.0)))


def _select_list(text: str) -> list[str]:
    return [c.strip() for c in text.split(", ")]


def _mix_sql(left: str, right: str) -> str:
    u = "CAST(round(speed * 10000) AS BIGINT)"
    played = half_away(f"((lo - pts_in) * {u})", "10000")
    ramp = (
        "CASE WHEN t < pts_in OR t >= pts_out THEN 0 ELSE least(CASE WHEN fade_in_pts > 0 AND t - pts_in < fade_in_pts THEN (t - pts_in) / fade_in_pts ELSE 1 END, "
        "CASE WHEN fade_out_pts > 0 AND pts_out - t < fade_out_pts THEN (pts_out - t) / fade_out_pts ELSE 1 END) END"
    )
    return (
        f"au AS (SELECT {_AUD} FROM embeddings), p0 AS (SELECT *, greatest(pts_in, job_in) AS lo, least(pts_out, job_out) AS hi FROM au WHERE NOT audio_muted), "
        f"p1 AS (SELECT *, (lo - job_in) * 48000 // 90000 AS first, ((hi - lo) * 48000 + 89999) // 90000 AS n, (source_in + {played}) * 48000 // 90000 AS s0, {u} AS u, {left} AS gl, {right} AS gr FROM p0 WHERE hi > lo), "
        "p2 AS (SELECT *, first + i AS idx, s0 + i * u // 10000 AS sample_idx FROM (SELECT *, unnest(range(n)) AS i FROM p1)), "
        "p3 AS (SELECT *, job_in + CAST(floor(idx * 90000 / 48000) AS BIGINT) AS t FROM p2), "
        f"mx AS (SELECT job_id, idx, sum(s.\"left\" * gl * {ramp}) AS l, sum(s.\"right\" * gr * {ramp}) AS r FROM p3 JOIN samples s USING (source_id, sample_idx) GROUP BY 1, 2), "
        "gr AS (SELECT job_id, unnest(range(((2400 - 30) * 48000 + 89999) // 90000)) AS idx FROM (SELECT DISTINCT job_id FROM au))"
    )


_PI4 = repr(math.pi / 4)
_PAN = f"(least(greatest(least(greatest(pan + track_pan, -1), 1), -1), 1) + 1) * {_PI4}"
_PC, _PT = f"(least(greatest(pan, -1), 1) + 1) * {_PI4}", f"(least(greatest(track_pan, -1), 1) + 1) * {_PI4}"
_OUT = (
    'SELECT job_id, idx, (round(CASE WHEN abs(l) <= 0.8 THEN l ELSE tanh(l) END + 1.2345e-10, 9) + 0.0e0) AS "left", (round(CASE WHEN abs(r) <= 0.8 THEN r ELSE tanh(r) END + 1.2345e-10, 9) + 0.0e0) AS "right" FROM '
    "(SELECT job_id, idx, coalesce(l, 0) * 0.9e0 AS l, coalesce(r, 0) * 0.9e0 AS r FROM gr LEFT JOIN mx USING (job_id, idx))"
)


def mix(lib: Lib, law: str) -> DataFrame:
    aud = placements(lib)
    jobs = aud.select("job_id").distinct().selectExpr("job_id", "30 AS pts_in", "2400 AS pts_out")
    out = audio.mix_timeline(jobs, aud, lib.samples, master_volume=0.9, pan_law=law, width=64)
    return out.select("job_id", "idx", rounded(F.col("left") + NUDGE, 9).alias("left"), rounded(F.col("right") + NUDGE, 9).alias("right"))


@q("u2_mix_timeline", "samples", _OUT, _mix_sql(f"gain * cos({_PAN})", f"gain * sin({_PAN})"))
def _(lib):
    return mix(lib, "add_clamp")


@q("u3_mix_multiply_pan", "samples", _OUT, _mix_sql(f"gain * (cos({_PC}) * cos({_PT}))", f"gain * (sin({_PC}) * sin({_PT}))"))
def _(lib):
    return mix(lib, "multiply")


@q("u4_fade_gain", "strip",
   "SELECT clip_id, round(CASE WHEN t < pts_in OR t >= pts_out THEN 0 ELSE least(CASE WHEN fade_in_pts > 0 AND t - pts_in < fade_in_pts THEN (t - pts_in) / fade_in_pts ELSE 1 END, "
   "CASE WHEN fade_out_pts > 0 AND pts_out - t < fade_out_pts THEN (pts_out - t) / fade_out_pts ELSE 1 END) END, 9) AS gain FROM (SELECT *, pts_in + clip_id * 37 % 100000 - 3000 AS t FROM strip)")
def _(lib):
    t = F.expr("pts_in + clip_id * 37 % 100000 - 3000")
    gain = audio.fade_gain(t, F.col("pts_in"), F.col("pts_out"), F.col("fade_in_pts"), F.col("fade_out_pts"))
    return lib.strip.select("clip_id", rounded(gain, 9).alias("gain"))


@q("u5_soft_limit", "samples",
   'SELECT source_id, sample_idx, round(CASE WHEN abs(v) <= 0.8 THEN v ELSE tanh(v) END + 1.2345e-10, 9) AS limited FROM (SELECT *, "left" * 3 AS v FROM samples)')
def _(lib):
    return lib.samples.select("source_id", "sample_idx", rounded(audio.soft_limit(F.col("left") * 3) + NUDGE, 9).alias("limited"))


_CHANNELS = "ch AS (SELECT vec_id AS source_id, CAST(i // 8 AS INTEGER) AS channel, CAST(i % 8 AS BIGINT) AS sample_idx, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings) WHERE i // 8 <= label % 8), lay AS (SELECT vec_id AS source_id, CASE vec_id % 4 WHEN 0 THEN 'Mono' WHEN 1 THEN 'Stereo' WHEN 2 THEN 'Surround5_1' ELSE 'Surround7_1' END AS layout FROM embeddings)"
_S2 = repr(1 / math.sqrt(2))


def _v(c: int) -> str:
    return f"coalesce(max(CASE WHEN channel = {c} THEN value END), 0)"


@q("u6_downmix", "",
   f'SELECT source_id, sample_idx, round(CASE any_value(layout) WHEN \'Mono\' THEN {_v(0)} WHEN \'Stereo\' THEN {_v(0)} WHEN \'Surround5_1\' THEN {_v(0)} + {_v(2)} * {_S2} + {_v(4)} * {_S2} + {_v(3)} * 0.5 '
   f'ELSE {_v(0)} + {_v(2)} * {_S2} + ({_v(4)} + {_v(6)}) * 0.5 + {_v(3)} * 0.5 END + 1.2345e-10, 9) AS "left", round(CASE WHEN any_value(layout) = \'Mono\' OR (any_value(layout) = \'Stereo\' AND max(channel) = 0) THEN {_v(0)} '
   f'WHEN any_value(layout) = \'Stereo\' THEN {_v(1)} WHEN any_value(layout) = \'Surround5_1\' THEN {_v(1)} + {_v(2)} * {_S2} + {_v(5)} * {_S2} + {_v(3)} * 0.5 ELSE {_v(1)} + {_v(2)} * {_S2} + ({_v(5)} + {_v(7)}) * 0.5 + {_v(3)} * 0.5 END + 1.2345e-10, 9) AS "right" '
   "FROM ch JOIN lay USING (source_id) GROUP BY 1, 2", _CHANNELS)
def _(lib):
    samples = lib.raw("embeddings").selectExpr("vec_id AS source_id", "label", "posexplode(embedding) AS (i, e)").selectExpr(
        "source_id", "cast(i div 8 AS int) AS channel", "cast(i % 8 AS bigint) AS sample_idx", "cast(e AS double) AS value", "label"
    ).where("channel <= label % 8").drop("label")
    layouts = lib.raw("embeddings").selectExpr(
        "vec_id AS source_id",
        "CASE vec_id % 4 WHEN 0 THEN 'Mono' WHEN 1 THEN 'Stereo' WHEN 2 THEN 'Surround5_1' ELSE 'Surround7_1' END AS layout",
    )
    out = audio.downmix(samples, layouts)
    return out.select("source_id", "sample_idx", rounded(F.col("left") + NUDGE, 9).alias("left"), rounded(F.col("right") + NUDGE, 9).alias("right"))
