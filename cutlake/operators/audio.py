"""Timeline audio as joins and grouped sums over sample tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import WIDE, clamp, idiv, wide
from cutlake.functions.timebase import TICKS_PER_SECOND, source_offset, speed_units
from cutlake.operators.filters import active_tracks
from cutlake.operators.rangejoin import overlapping_intervals, points_in_intervals

RATE = 48_000
_BLOCK = 1 << 16


def audible_clips(jobs: DataFrame, clips: DataFrame, tracks: DataFrame, sources: DataFrame) -> DataFrame:
    """Clips each job hears: in its range, with audio, on an active track.

    Gain is clip times track, pan their clamped sum; a clip whose track is unknown
    plays at unity. ``jobs(job_id, project_id, pts_in, pts_out)``; the result keeps
    the job range as ``job_in``/``job_out`` and the parts of gain and pan.
    """
    spans = jobs.select("job_id", "project_id", F.col("pts_in").alias("job_in"), F.col("pts_out").alias("job_out"))
    heard = clips.join(sources.where("has_audio").select("project_id", "source_id"), ["project_id", "source_id"], "left_semi")
    active = active_tracks(tracks).select("project_id", "track_id", F.lit(True).alias("__on"))
    known = tracks.select("project_id", "track_id", F.col("gain").alias("track_gain"), F.col("pan").alias("track_pan"))
    known = known.join(active, ["project_id", "track_id"], "left").withColumn("__known", F.lit(True))
    heard = heard.join(known, ["project_id", "track_id"], "left")
    heard = heard.where(F.col("__known").isNull() | F.col("__on")).drop("__known", "__on")
    hits = overlapping_intervals(spans, heard, ["project_id"], ("job_in", "job_out"), ("pts_in", "pts_out"))
    hits = hits.withColumns(
        {"track_gain": F.coalesce("track_gain", F.lit(1.0)), "track_pan": F.coalesce("track_pan", F.lit(0.0))}
    )
    return hits.withColumns(
        {
            "gain": F.col("volume") * F.col("track_gain"),
            "mix_pan": clamp(F.col("pan") + F.col("track_pan"), -1, 1),
        }
    )


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant-power (left, right) gains for a pan of -1 to 1."""
    angle = (clamp(pan, -1, 1) + 1) * F.lit(math.pi / 4)
    return F.cos(angle), F.sin(angle)


def fade_gain(pts: Column, lo: Column, hi: Column, fade_in: Column, fade_out: Column) -> Column:
    """0 outside [lo, hi), else the lower of the two ramps."""
    rise = F.when((fade_in > 0) & (pts - lo < fade_in), (pts - lo) / fade_in).otherwise(1.0)
    fall = F.when((fade_out > 0) & (hi - pts < fade_out), (hi - pts) / fade_out).otherwise(1.0)
    return F.when((pts < lo) | (pts >= hi), 0.0).otherwise(F.least(rise, fall))


def soft_limit(sample: Column) -> Column:
    """Unchanged up to 0.8, tanh above; the step at 0.8 is part of the definition."""
    return F.when(F.abs(sample) <= 0.8, sample).otherwise(F.tanh(sample))


def _samples(pts: Column, rate: int, up: bool = False) -> Column:
    num = (wide(pts) * wide(rate)).cast(WIDE)
    return idiv((num + (TICKS_PER_SECOND - 1 if up else 0)).cast(WIDE), F.lit(TICKS_PER_SECOND))


def mix_timeline(
    jobs: DataFrame,
    audible: DataFrame,
    samples: DataFrame,
    master_volume: float = 1.0,
    pan_law: str = "add_clamp",
    rate: int = RATE,
    width: int = 4096,
) -> DataFrame:
    """One stereo sample per job and output index: placed, faded, panned, summed, limited.

    ``samples(source_id, sample_idx, left, right)`` are decoded at ``rate``; a clip's
    speed picks the nearest earlier source sample. ``pan_law`` 'add_clamp' pans by
    the summed pan, 'multiply' by the product of both gain pairs. Gaps are zero.
    """
    lo, hi = F.greatest("pts_in", "job_in"), F.least("pts_out", "job_out")
    unit = F.greatest(speed_units(F.col("speed")), F.lit(1))
    placed = audible.where(~F.coalesce("audio_muted", F.lit(False))).withColumns(
        {
            "__at": _samples(lo - F.col("job_in"), rate),
            "__n": _samples(hi - lo, rate, up=True),
            "__u": unit,
            "__s0": _samples(F.col("source_in") + source_offset(lo - F.col("pts_in"), F.col("speed")), rate),
        }
    )
    # Source samples played: those the last output sample still reaches.
    placed = placed.withColumn("__s1", F.col("__s0") + idiv((F.col("__n") - 1) * F.col("__u"), F.lit(10000)) + 1)
    if pan_law == "add_clamp":
        left, right = pan_gains(F.col("mix_pan"))
    else:
        (cl, cr), (tl, tr) = pan_gains(F.col("pan")), pan_gains(F.col("track_pan"))
        left, right = cl * tl, cr * tr
    placed = placed.select(
        "job_id", "source_id", "__at", "__n", "__u", "__s0", "__s1", "job_in",
        F.col("pts_in").alias("__in"), F.col("pts_out").alias("__out"), "fade_in_pts", "fade_out_pts",
        (F.col("gain") * left).alias("__gl"), (F.col("gain") * right).alias("__gr"),
    )
    hits = points_in_intervals(samples, placed, ["source_id"], "sample_idx", "__s0", "__s1", width=width)
    # Output samples whose nearest earlier source sample is this one.
    k = F.col("sample_idx") - F.col("__s0")
    first = idiv(k * 10000 + F.col("__u") - 1, F.col("__u"))
    last = F.least(idiv((k + 1) * 10000 + F.col("__u") - 1, F.col("__u")) - 1, F.col("__n") - 1)
    out = hits.withColumns({"__f": first, "__l": last}).where("__f <= __l")
    out = out.withColumn("__i", F.explode(F.sequence("__f", "__l"))).withColumn("idx", F.col("__at") + F.col("__i"))
    pts = F.col("job_in") + F.floor(F.col("idx") * TICKS_PER_SECOND / F.lit(float(rate)))
    fade = fade_gain(pts, F.col("__in"), F.col("__out"), F.col("fade_in_pts"), F.col("fade_out_pts"))
    summed = out.groupBy("job_id", "idx").agg(
        F.sum(F.col("left") * F.col("__gl") * fade).alias("left"),
        F.sum(F.col("right") * F.col("__gr") * fade).alias("right"),
    )
    grid = _sample_grid(jobs, rate).join(summed, ["job_id", "idx"], "left")
    master = F.lit(float(master_volume))
    return grid.select(
        "job_id", "idx", *[soft_limit(F.coalesce(c, F.lit(0.0)) * master).alias(c) for c in ("left", "right")]
    )


def _sample_grid(jobs: DataFrame, rate: int) -> DataFrame:
    """Every output sample index of every job, generated in spread-out blocks."""
    n = jobs.select("job_id", _samples(F.col("pts_out") - F.col("pts_in"), rate, up=True).alias("__n"))
    n = n.where("__n > 0")
    blocks = n.withColumn(
        "__b", F.explode(F.sequence(F.lit(0).cast("bigint"), idiv(F.col("__n") - 1, F.lit(_BLOCK))))
    ).repartition("job_id", "__b")
    start = F.col("__b") * _BLOCK
    idx = F.explode(F.sequence(start, F.least(start + (_BLOCK - 1), F.col("__n") - 1)))
    return blocks.select("job_id", idx.alias("idx"))


_R = 1 / math.sqrt(2)
# Share of each input channel in (left, right), by layout.
DOWNMIX = {
    "Mono": [(1, 1)],
    "Stereo": [(1, 0), (0, 1)],
    "Surround5_1": [(1, 0), (0, 1), (_R, _R), (0.5, 0.5), (_R, 0), (0, _R)],
    "Surround7_1": [(1, 0), (0, 1), (_R, _R), (0.5, 0.5), (0.5, 0), (0, 0.5), (0.5, 0), (0, 0.5)],
}


def downmix(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """Stereo from channel rows ``(source_id, channel, sample_idx, value)``.

    ``sources(source_id, layout)``. Channels a layout does not name are ignored,
    missing ones are silent; stereo material with one channel plays it on both sides.
    """
    channels = samples.groupBy("source_id").agg(F.max("channel").alias("top"))
    kind = sources.join(channels, "source_id").select(
        "source_id",
        F.when((F.col("layout") == "Stereo") & (F.col("top") == 0), "Mono").otherwise(F.col("layout")).alias("layout"),
    )
    share_l, share_r = F, F
    for layout, shares in DOWNMIX.items():
        for ch, (lft, rgt) in enumerate(shares):
            here = (F.col("layout") == layout) & (F.col("channel") == ch)
            share_l, share_r = share_l.when(here, F.lit(float(lft))), share_r.when(here, F.lit(float(rgt)))
    return (
        samples.join(kind, "source_id")
        .groupBy("source_id", "sample_idx")
        .agg(
            F.sum(F.col("value") * share_l.otherwise(0.0)).alias("left"),
            F.sum(F.col("value") * share_r.otherwise(0.0)).alias("right"),
        )
    )
