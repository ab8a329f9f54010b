"""Row filters and per-row resolution over timeline tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators.rangejoin import overlapping_intervals


def active_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that contribute: never muted ones; only soloed ones once any is soloed."""
    solo = tracks.groupBy("project_id").agg(F.max("solo").alias("__any_solo"))
    return (
        tracks.join(solo, "project_id")
        .where(~F.col("mute") & (~F.col("__any_solo") | F.col("solo")))
        .drop("__any_solo")
    )


def visual_clips(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clips not on an audio track. A clip whose track is unknown stays."""
    kinds = tracks.select("project_id", "track_id", F.col("kind").alias("__kind"))
    joined = clips.join(kinds, ["project_id", "track_id"], "left")
    return joined.where(F.coalesce("__kind", F.lit("")) != "Audio").drop("__kind")


def clips_overlapping(clips: DataFrame, start: int, end: int) -> DataFrame:
    """Clips sharing time with the half-open [start, end)."""
    return clips.where((F.col("pts_in") < end) & (F.col("pts_out") > start))


def markers_in_range(markers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Markers in each range; one ending exactly at the range start still counts.

    ``ranges(project_id, range_id, start_pts, end_pts)``.
    """
    closed_end = F.col("pts") + F.coalesce("duration_pts", F.lit(0)) + 1
    m = markers.withColumn("__m_end", closed_end)
    out = overlapping_intervals(
        ranges, m, ["project_id"], ("start_pts", "end_pts"), ("pts", "__m_end")
    )
    return out.drop("__m_end")


def enabled_effects(effects: DataFrame) -> DataFrame:
    """Effects that are switched on; ``position`` keeps the list order."""
    return effects.where("enabled")


def refresh_media_status(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Absent files become Missing; Missing files that reappear become Available."""
    present = listing.select("path").distinct().withColumn("__present", F.lit(True))
    status = (
        F.when(F.col("__present").isNull(), "Missing")
        .when(F.col("status") == "Missing", "Available")
        .otherwise(F.col("status"))
    )
    return sources.join(present, "path", "left").withColumn("status", status).drop("__present")


def offline_sources(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources whose file is not in the listing."""
    return sources.join(listing.select("path").distinct(), "path", "left_anti")


# Container colour codes.
MATRIX_CODES = {1: "Bt709", 5: "Bt601", 6: "Bt601", 9: "Bt2020", 10: "Bt2020"}
RANGE_CODES = {1: "Limited", 2: "Full"}
PRIMARY_CODES = {1: "Bt709", 9: "Bt2020"}
TRANSFER_CODES = {
    1: "Bt709", 8: "Linear", 13: "Srgb", 14: "Bt2020", 15: "Bt2020", 16: "Pq", 18: "Hlg",
}


def _decode(code: str, names: dict[int, str]) -> Column:
    out = F
    for raw, name in names.items():
        out = out.when(F.col(code) == raw, name)
    return out.otherwise("Unknown")


def resolve_color(sources: DataFrame) -> DataFrame:
    """Colour description per source: container codes, then the gaps filled in.

    Order matters: matrix from the signals or size, then range, then primaries
    from the matrix, then transfer from matrix and depth.
    """
    unknown = "Unknown"
    wide_signal = (F.col("primaries") == "Bt2020") | F.col("transfer_fn").isin("Pq", "Hlg", "Bt2020")
    small = F.col("width").between(1, 1279) & F.col("height").between(1, 719)
    inferred = (
        F.when(wide_signal | (F.col("width") >= 3840) | (F.col("height") >= 2160), "Bt2020")
        .when(small, "Bt601")
        .otherwise("Bt709")
    )
    decoded = sources.withColumns(
        {
            "matrix": _decode("matrix_raw", MATRIX_CODES),
            "range": _decode("range_raw", RANGE_CODES),
            "primaries": _decode("pri_raw", PRIMARY_CODES),
            "transfer_fn": _decode("trc_raw", TRANSFER_CODES),
            "bit_depth": F.when(F.col("bit_depth") == 0, 8).otherwise(F.col("bit_depth")),
        }
    )
    filled = decoded.withColumn(
        "matrix", F.when(F.col("matrix") == unknown, inferred).otherwise(F.col("matrix"))
    ).withColumn("range", F.when(F.col("range") == unknown, "Limited").otherwise(F.col("range")))
    is_2020 = F.col("matrix") == "Bt2020"
    return filled.withColumns(
        {
            "primaries": F.when(F.col("primaries") != unknown, F.col("primaries"))
            .when(is_2020, "Bt2020")
            .otherwise("Bt709"),
            "transfer_fn": F.when(F.col("transfer_fn") != unknown, F.col("transfer_fn"))
            .when(is_2020 & (F.col("bit_depth") >= 10), "Pq")
            .otherwise("Bt709"),
        }
    )


# What each codec can carry.
CRF_CODECS = ("H264", "H265")
HDR_CODECS = ("H265", "ProRes", "Vp9")


def validate_jobs(jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule a job breaks, NULL for a valid job.

    ``folders(output_dir)`` lists the existing output folders.
    """
    known = folders.select("output_dir").distinct().withColumn("__dir", F.lit(True))
    no_crf = (F.col("quality") == "Crf") & ~F.col("codec").isin(*CRF_CODECS)
    no_hdr = F.col("transfer").isin("Pq", "Hlg") & ~F.col("codec").isin(*HDR_CODECS)
    error = (
        F.when(F.col("pts_in") >= F.col("pts_out"), "NegativeDuration")
        .when((F.col("width") == 0) | (F.col("height") == 0), "ZeroDimension")
        .when((F.col("fps_num") == 0) | (F.col("fps_den") == 0), "ZeroFrameRate")
        .when(F.col("threads") == 0, "ZeroThreads")
        .when(no_crf, "CrfNotSupported")
        .when(no_hdr, "HdrNotSupported")
        .when(F.col("__dir").isNull(), "BadOutputPath")
    )
    return jobs.join(known, "output_dir", "left").withColumn("error", error).drop("__dir")
