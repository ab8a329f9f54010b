"""Timeline joins: active clips, keyframes, markers, boundaries, snapping, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.arith import clamp
from cutlake.functions.timebase import source_offset
from cutlake.operators.asof import asof_neighbours
from cutlake.operators.rangejoin import WIDTH, overlapping_intervals, points_in_intervals


def active_at(
    points: DataFrame, clips: DataFrame, width: int = WIDTH, long_width: int | None = None
) -> DataFrame:
    """Clips playing at each ``points(project_id, pts, ...)`` with their source time."""
    hits = points_in_intervals(
        points, clips, ["project_id"], "pts", "pts_in", "pts_out", width=width, long_width=long_width
    )
    played = source_offset(F.col("pts") - F.col("pts_in"), F.col("speed"))
    return hits.withColumn("source_pts", played + F.col("source_in"))


def active_on_track(points: DataFrame, clips: DataFrame, track_id: int) -> DataFrame:
    """``active_at`` for one track; the filter sits below the bucket expansion."""
    return active_at(points, clips.where(F.col("track_id") == track_id))


def overlap_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("project_id",), width: int = WIDTH
) -> DataFrame:
    """Overlapping clip pairs. ``b`` columns other than the keys get the prefix ``b_``."""
    other = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    return overlapping_intervals(
        a, other, keys, ("pts_in", "pts_out"), ("b_pts_in", "b_pts_out"), width=width
    )


def eval_keyframes(queries: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Adds ``value`` of the animated parameter at each (project, clip, param, pts).

    Held before the first and after the last key; NULL where there are no keys.
    """
    found = asof_neighbours(
        queries,
        keyframes.withColumnRenamed("pts", "kpts"),
        ["project_id", "clip_id", "param"],
        "pts",
        "kpts",
        ["value", "interp"],
        sides=("prev", "next"),
    )
    prev, nxt = F.col("prev"), F.col("next")
    part = (F.col("pts") - prev["kpts"]) / (nxt["kpts"] - prev["kpts"])
    line = prev["value"] + (nxt["value"] - prev["value"]) * part
    value = (
        F.when(prev["kpts"].isNull(), nxt["value"])
        .when(nxt["kpts"].isNull() | (prev["kpts"] == F.col("pts")), prev["value"])
        .when(prev["interp"] == "Hold", prev["value"])
        .otherwise(line)
    )
    return found.withColumn("value", value).drop("prev", "next")


# Animated parameter -> the clip column it overrides.
ANIMATED = {
    "Opacity": "opacity",
    "PositionX": "position_x",
    "PositionY": "position_y",
    "Scale": "scale",
    "Rotation": "rotation",
    "CropLeft": "crop_left",
    "CropTop": "crop_top",
    "CropRight": "crop_right",
    "CropBottom": "crop_bottom",
    "CropFeather": "crop_feather",
    "Brightness": "brightness",
    "Contrast": "contrast",
    "Saturation": "saturation",
    "HueShift": "hue",
    "BlurRadius": "blur_radius",
    "BlurSigma": "blur_sigma",
    "SharpenAmount": "sharpen_amount",
    "VignetteIntensity": "vignette_intensity",
    "VignetteRadius": "vignette_radius",
    "VignetteSoftness": "vignette_softness",
    "VignetteRoundness": "vignette_roundness",
    "ChromaKeyTolerance": "chroma_key_tolerance",
    "ChromaKeySoftness": "chroma_key_softness",
}

# Parameter defaults of a clip that sets none.
CLIP_DEFAULTS = {
    "opacity": 1.0, "position_x": 0.0, "position_y": 0.0, "scale_x": 1.0, "scale_y": 1.0,
    "rotation": 0.0, "crop_left": 0.0, "crop_top": 0.0, "crop_right": 1.0, "crop_bottom": 1.0,
    "crop_feather": 0.0, "brightness": 0.0, "contrast": 1.0, "saturation": 1.0, "hue": 0.0,
    "blur_radius": 10.0, "blur_sigma": 5.0, "sharpen_amount": 0.5, "vignette_intensity": 0.5,
    "vignette_radius": 0.75, "vignette_softness": 0.45, "vignette_roundness": 1.0,
    "chroma_key_tolerance": 0.3, "chroma_key_softness": 0.1,
}


def clip_state_at(active: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Active clips with every animatable attribute resolved at ``pts``.

    An animated value replaces the clip's own column, opacity clamped to 0..1; a
    column the clip table lacks falls back to its default. Volume and pan keys are
    not applied here.
    """
    keys = keyframes.where(F.col("param").isin(*ANIMATED))
    # At most one row per parameter and clip, and only for clips that are animated.
    params = keys.select("project_id", "clip_id", "param").distinct()
    wanted = active.select("project_id", "clip_id", "pts").distinct().join(
        params, ["project_id", "clip_id"]
    )
    values = (
        eval_keyframes(wanted, keys)
        .groupBy("project_id", "clip_id", "pts")
        .agg(
            *[
                F.max(F.when(F.col("param") == p, F.col("value"))).alias(f"__{c}")
                for p, c in ANIMATED.items()
            ]
        )
    )
    out = active.join(values, ["project_id", "clip_id", "pts"], "left")

    def static(name: str) -> Column:
        default = F.lit(CLIP_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in active.columns else default

    state = {c: F.coalesce(F.col(f"__{c}"), static(c)) for c in ANIMATED.values() if c != "scale"}
    state["opacity"] = F.coalesce(clamp(F.col("__opacity"), 0, 1), static("opacity"))
    state["scale_x"] = F.coalesce(F.col("__scale"), static("scale_x"))
    state["scale_y"] = F.coalesce(F.col("__scale"), static("scale_y"))
    return out.withColumns(state).drop(*[f"__{c}" for c in ANIMATED.values()])


def nearest_marker(points: DataFrame, markers: DataFrame) -> DataFrame:
    """Marker closest in time; an equal distance goes to the earlier, then older one."""
    found = asof_neighbours(
        points,
        markers.withColumnRenamed("pts", "marker_pts"),
        ["project_id"],
        "pts",
        "marker_pts",
        ["marker_id"],
        sides=("prev", "next"),
    )
    t, prev, nxt = F.col("pts"), F.col("prev"), F.col("next")
    take_prev = nxt.isNull() | (t - prev["marker_pts"] <= nxt["marker_pts"] - t)
    best = F.when(prev.isNotNull() & take_prev, prev).otherwise(nxt)
    return found.withColumn("__m", best).select(
        *points.columns, F.col("__m.marker_id"), F.col("__m.marker_pts")
    )


def next_boundary(points: DataFrame, clips: DataFrame) -> DataFrame:
    """First clip start or end strictly after each point; NULL after the last."""
    edges = clips.select("project_id", F.explode(F.array("pts_in", "pts_out")).alias("edge"))
    found = asof_neighbours(
        points, edges, ["project_id"], "pts", "edge", [], sides=("next",), strict=True
    )
    return found.withColumn("boundary", F.col("next.edge")).drop("next")


SOURCE = ["project_id", "source_id"]


def resolve_proxy(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``decode_source_id``: the source's proxy if it has one, else the source.

    Source ids count within their project; one source has one row.
    """
    proxies = sources.where(F.col("proxy_id").isNotNull()).select(*SOURCE, "proxy_id")
    out = clips.join(proxies, SOURCE, "left")
    return out.withColumn("decode_source_id", F.coalesce("proxy_id", "source_id")).drop("proxy_id")


def relink(sources: DataFrame, relinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New paths by project and source id, status back to Available; and the rejected relinks.

    A relink without a path, of an unknown source, or of a source that another row of
    ``relinks`` names too, is rejected.
    """
    named = relinks.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("__n"))
    known = sources.select(*SOURCE, F.lit(True).alias("__known")).distinct()
    reason = F.when(F.col("new_path").isNull(), "MissingPath").when(F.col("__known").isNull(), "NotFound").when(F.col("__n") > 1, "DuplicateEdit")
    # Null ids meet nothing and are rejected as unknown.
    judged = relinks.select(*SOURCE, "new_path").join(named, SOURCE, "left").join(known, SOURCE, "left").withColumn("reason", reason)
    new = judged.where(F.col("reason").isNull()).select(*SOURCE, "new_path")
    out = sources.join(new, SOURCE, "left").withColumns(
        {
            "path": F.coalesce("new_path", "path"),
            "status": F.when(F.col("new_path").isNotNull(), "Available").otherwise(F.col("status")),
        }
    )
    return out.drop("new_path"), judged.where(F.col("reason").isNotNull()).select(*SOURCE, "new_path", "reason")


def seek_points(targets: DataFrame, packets: DataFrame) -> DataFrame:
    """Last sync packet at or before each ``targets(source_id, pts)``."""
    sync = packets.where(F.col("is_key") == 1).withColumnRenamed("pts", "key_pts")
    found = asof_neighbours(targets, sync, ["source_id"], "pts", "key_pts", ["seq"])
    return found.select(
        *targets.columns, F.col("prev.key_pts").alias("key_pts"), F.col("prev.seq").alias("key_seq")
    )


def linked_clips(clips: DataFrame) -> DataFrame:
    """Pairs of clips on different tracks sharing source and start: they edit together."""
    key = ["project_id", "source_id", "pts_in"]
    other = clips.select(*key, F.col("track_id").alias("linked_track_id"), F.col("clip_id").alias("linked_clip_id"))
    pairs = clips.select(*key, "track_id", "clip_id").join(other, key)
    return pairs.where(F.col("track_id") != F.col("linked_track_id"))


def link_groups(clips: DataFrame) -> DataFrame:
    """Each linked clip once, with its group: project_id, clip_id, track_id, link_id and n_clips.

    A group holds the clips of a project with one source and start, on two tracks at least; its
    id is the smallest clip id. It says what ``linked_clips`` says, in one row a clip instead
    of one a pair, however many clips are linked.
    """
    key = ["project_id", "source_id", "pts_in"]
    groups = clips.groupBy(*key).agg(
        F.min("clip_id").alias("link_id"), F.count(F.lit(1)).alias("n_clips"), F.min("track_id").alias("__low"), F.max("track_id").alias("__high")
    ).where("__low <> __high")
    return clips.join(groups, key).select("project_id", "clip_id", "track_id", "link_id", "n_clips")


_LAST = (1 << 63) - 1


def snap_targets(moves: DataFrame, clips: DataFrame, width: int = 256) -> DataFrame:
    """Where a dragged clip snaps: the nearest edge of another clip, or the playhead.

    ``moves(project_id, clip_id, new_frame, duration_frames, playhead, threshold)``,
    ``clips(project_id, clip_id, pts_in, in_frame, out_frame)``. Ties go to the clip
    earliest in the timeline, its start before its end, the dragged clip's start
    before its end, the playhead last.
    """
    edges = clips.select(
        "project_id",
        F.explode(
            F.array(
                F.struct(F.col("in_frame").alias("at"), F.lit(0).alias("kind")),
                F.struct(F.col("out_frame").alias("at"), F.lit(1).alias("kind")),
            )
        ).alias("e"),
        F.col("pts_in").alias("o_pts"),
        F.col("clip_id").alias("o_clip"),
    ).select("project_id", F.col("e.at").alias("at"), F.struct("o_pts", "o_clip", "e.kind").alias("o"))
    # Two candidates per frame are enough: the first one, and the first of any other
    # clip, which serves the moves of the first clip itself.
    first = edges.groupBy("project_id", "at").agg(F.min("o").alias("first"))
    second = (
        edges.join(first, ["project_id", "at"])
        .where(F.col("o.o_clip") != F.col("first.o_clip"))
        .groupBy("project_id", "at")
        .agg(F.min("o").alias("o"))
    )
    offers = first.withColumnRenamed("first", "o").unionByName(second)

    m = moves.withColumn(
        "side",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("s"), F.col("new_frame").alias("pos")),
                F.struct(F.lit(2).alias("s"), (F.col("new_frame") + F.col("duration_frames")).alias("pos")),
            )
        ),
    ).select("*", "side.*")
    reach = m.withColumns(
        {"lo": F.col("pos") - F.col("threshold"), "hi": F.col("pos") + F.col("threshold") + 1}
    )
    back = F.when(F.col("s") == 2, F.col("duration_frames")).otherwise(F.lit(0))
    near = points_in_intervals(offers, reach, ["project_id"], "at", "lo", "hi", width=width)
    near = near.where(F.col("o.o_clip") != F.col("clip_id")).select(
        "project_id",
        "clip_id",
        F.struct(
            F.abs(F.col("pos") - F.col("at")).alias("diff"),
            F.col("o.o_pts").alias("p"),
            F.col("o.o_clip").alias("c"),
            (F.col("s") + F.col("o.kind")).alias("j"),
            (F.col("at") - back).alias("target"),
        ).alias("best"),
    )
    head = m.where(F.abs(F.col("pos") - F.col("playhead")) <= F.col("threshold")).select(
        "project_id",
        "clip_id",
        F.struct(
            F.abs(F.col("pos") - F.col("playhead")).alias("diff"),
            F.lit(_LAST).alias("p"),
            F.lit(_LAST).alias("c"),
            (F.col("s") + 4).alias("j"),
            (F.col("playhead") - back).alias("target"),
        ).alias("best"),
    )
    best = near.unionByName(head).groupBy("project_id", "clip_id").agg(F.min("best").alias("best"))
    out = moves.join(best, ["project_id", "clip_id"], "left")
    return out.select(
        *moves.columns,
        F.when(F.col("best").isNotNull(), F.greatest(F.col("best.target"), F.lit(0)))
        .otherwise(F.col("new_frame"))
        .alias("snapped_frame"),
        F.col("best").isNotNull().alias("is_snapped"),
    )


def align_series(a: DataFrame, b: DataFrame, keys: Sequence[str], span: int = 3) -> DataFrame:
    """Frame offset at which two sampled series agree best, by worst channel difference.

    Series rows are ``(keys, idx, cell, r, g, b)``; frames with different cell sets
    are not compared. Also reports the difference at offset zero.
    """
    keys = list(keys)

    def sized(df: DataFrame) -> DataFrame:
        n = df.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("cells"))
        return df.join(n, [*keys, "idx"])

    left = sized(a).withColumn("offset", F.explode(F.sequence(F.lit(-span), F.lit(span))))
    left = left.withColumn("idx", F.col("idx") + F.col("offset"))
    right = sized(b).select(*keys, "idx", "cell", "cells", *[F.col(c).alias(f"o_{c}") for c in "rgb"])
    worst = F.greatest(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in "rgb"])
    per_offset = (
        left.join(right, [*keys, "idx", "cell", "cells"])
        .groupBy(*keys, "offset")
        .agg(F.max(worst).alias("delta"))
    )
    best = per_offset.groupBy(*keys).agg(
        F.min(F.struct("delta", "offset")).alias("best"),
        F.max(F.when(F.col("offset") == 0, F.col("delta"))).alias("zero"),
    )
    return best.select(
        *keys,
        F.col("best.offset").alias("offset"),
        F.col("best.delta").alias("delta"),
        F.coalesce("zero", "best.delta").alias("delta_aligned"),
    )


def compare_frames(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Per frame: largest and mean channel difference, missing pixels, pass or fail."""
    at = ["frame_id", "x", "y"]
    left = a.select(*at, *[F.col(c).alias(f"a_{c}") for c in "rgb"])
    right = b.select(*at, *[F.col(c).alias(f"b_{c}") for c in "rgb"])
    diffs = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "rgb"]
    joined = left.join(right, at, "full").withColumns(
        {
            "worst": F.greatest(*diffs),
            "total": diffs[0] + diffs[1] + diffs[2],
            "absent": F.col("a_r").isNull() | F.col("b_r").isNull(),
        }
    )
    out = joined.groupBy("frame_id").agg(
        F.max(F.when(~F.col("absent"), F.col("worst"))).alias("max_diff"),
        (F.avg(F.when(~F.col("absent"), F.col("total"))) / 3).alias("mean_diff"),
        F.sum(F.col("absent").cast("bigint")).alias("missing"),
    )
    passed = (F.col("missing") == 0) & (F.col("max_diff") <= F.lit(float(tolerance)))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def frame_manifest(points: DataFrame, clips: DataFrame, width: int = WIDTH) -> DataFrame:
    """Playing clips of every frame, numbered bottom to top.

    A frame holds no more clips than there are 16-bit layers, so its window is small.
    """
    w = Window.partitionBy("project_id", "pts").orderBy("layer_order", "clip_id")
    return active_at(points, clips, width).withColumn("z", F.row_number().over(w).cast("bigint"))
