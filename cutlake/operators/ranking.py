"""Top-k and reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def worst_frames(latency: DataFrame, n: int) -> DataFrame:
    """The n latest frames of each run, worst first; ties by frame index.

    Spark prunes each task to its own n best per run before the shuffle.
    """
    w = Window.partitionBy("run_id").orderBy(F.desc("latency_ms"), "frame_index")
    ranked = latency.where(F.col("latency_ms").isNotNull()).withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= n)


def top_nodes(timings: DataFrame, k: int) -> DataFrame:
    """The k costliest nodes by frame total."""
    return timings.orderBy(F.desc("frame_total_ms"), *[c for c in timings.columns if c in ("run_id", "node")]).limit(k)


def reorder_tracks(tracks: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move one track per project to a new position; the ones between shift by one.

    ``moves(project_id, track_id, new_index)``. Rejects carry TrackNotFound or
    TrackLimitReached.
    """
    count = tracks.groupBy("project_id").agg(F.count(F.lit(1)).alias("__len"))
    now = tracks.select("project_id", "track_id", F.col("position").alias("__from"))
    checked = moves.join(now, ["project_id", "track_id"], "left").join(count, "project_id", "left")
    reason = F.when(F.col("__from").isNull(), "TrackNotFound").when(
        (F.col("new_index") > F.col("__len")) | (F.col("new_index") < 0), "TrackLimitReached"
    )
    checked = checked.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        "project_id", "__from", F.least(F.col("new_index"), F.col("__len") - 1).alias("__to")
    )
    p, a, b = F.col("position"), F.col("__from"), F.col("__to")
    place = (
        F.when(a.isNull(), p)
        .when(p == a, b)
        .when((p > a) & (p <= b), p - 1)
        .when((p < a) & (p >= b), p + 1)
        .otherwise(p)
    )
    out = tracks.join(good, "project_id", "left").withColumn("position", place.cast("int"))
    rejects = checked.where(F.col("reason").isNotNull()).select(*moves.columns, "reason")
    return out.select(*tracks.columns), rejects
