"""Ordered per-group operators: slots, gaps, intervals, stamp repair, blur lines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.arith import grid_floor, wide
from cutlake.functions.timebase import frame_start
from cutlake.operators.asof import asof_neighbours
from cutlake.operators.scan import CELL, Scan, cell_totals, chunked_scan, joined_on, ranked


def track_slots(clips: DataFrame) -> DataFrame:
    """0-based position of each clip on its track by start, then id."""
    out = ranked(clips, ["project_id", "track_id"], "pts_in", "clip_id", "slot")
    return out.withColumn("slot", F.col("slot") - 1)


def frame_intervals(frames: DataFrame) -> DataFrame:
    """Milliseconds since the previous retired frame of the run; NULL on the first.

    ``frames(run_id, frame_index, retired_us)``, one row per stamp.
    """
    found = asof_neighbours(
        frames, frames.select("run_id", F.col("retired_us").alias("before_us")),
        ["run_id"], "retired_us", "before_us", [], strict=True, cell=1 << 28,
    )
    gap = (F.col("retired_us") - F.col("prev.before_us")) / 1000
    return found.withColumn("latency_ms", gap).drop("prev")


def _reach(clips: DataFrame) -> DataFrame:
    """Per (track, start): latest end among clips starting strictly earlier."""
    starts = clips.groupBy("project_id", "track_id", "pts_in").agg(F.max("pts_out").alias("end"))
    return chunked_scan(
        starts, ["project_id", "track_id"], "pts_in", [Scan("reach", "max", F.col("end"), inclusive=False)]
    )


def track_gaps(clips: DataFrame) -> DataFrame:
    """Empty stretches between clips of a track."""
    gap = F.col("pts_in") > F.col("reach")
    return _reach(clips).where(gap).select(
        "project_id", "track_id", F.col("reach").alias("gap_in"), F.col("pts_in").alias("gap_out")
    )


def overlapped_clips(clips: DataFrame) -> DataFrame:
    """Clips that start before an earlier clip of their track has ended."""
    key = ["project_id", "track_id", "pts_in"]
    per_start = clips.groupBy(*key).agg(F.min("clip_id").alias("first_id"))
    out = clips.join(_reach(clips).select(*key, "reach"), key).join(per_start, key)
    late = (F.col("reach") > F.col("pts_in")) | (F.col("clip_id") != F.col("first_id"))
    return out.where(late).drop("reach", "first_id")


def check_dts(packets: DataFrame) -> DataFrame:
    """Packets whose dts does not exceed that of the packet before them.

    ``packets(stream_id, seq, dts)`` with a dense-ish unique ``seq`` per stream.
    """
    out = chunked_scan(packets, ["stream_id"], "seq", [Scan("prev_dts", "last", F.col("dts"), inclusive=False)])
    return out.where(F.col("dts") <= F.col("prev_dts"))


def repair_dts(packets: DataFrame, cell: int = CELL) -> DataFrame:
    """Strictly increasing ``dts``: each at least one past the one before it.

    dts'_i = i + max_{j<=i}(dts_j - j) with i the packet's rank in its stream. A cell counts from its
    own first packet; what the cells before it hold comes as one row per cell.
    """
    key = ["stream_id", "__cell"]
    cells = packets.withColumn("__cell", grid_floor("seq", cell)).repartition(*key)
    ahead = Window.partitionBy(*key).orderBy("seq")
    local = cells.withColumn("nth", F.row_number().over(ahead).cast("bigint"))
    local = local.withColumn("top", F.max(F.col("dts") - F.col("nth")).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    totals = cell_totals(local, ["stream_id"], [F.max("nth").alias("__n"), F.max("top").alias("__top")])
    earlier = Window.partitionBy("stream_id").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("bigint")))
    carries = begun.select(*joined_on(["stream_id"]), "__before", F.max(F.col("__top") - F.col("__before")).over(earlier).alias("__floor"))
    out = local.join(carries, key, "left")
    dts = F.col("nth") + F.col("__before") + F.greatest(F.col("top") - F.col("__before"), "__floor")
    return out.withColumn("dts", dts).select(*packets.columns)


def grid_uniform(grid: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: frame steps within a tick of nominal, start and span as asked for.

    ``grid(job_id, frame, pts)``; neighbours are joined by frame number. A grid is larger than the
    jobs it was exploded from, by which Spark judges it, so nothing of it may be broadcast.
    """
    step = frame_start(F.lit(1), F.col("fps_num"), F.col("fps_den"))
    nxt = grid.select("job_id", (F.col("frame") - 1).alias("frame"), F.col("pts").alias("next_pts"))
    gap = F.col("next_pts") - F.col("pts")
    seen = grid.hint("merge").join(nxt, ["job_id", "frame"], "left").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(gap).alias("least"),
        F.max(gap).alias("most"),
        F.min("pts").alias("first_pts"),
        F.max("pts").alias("last_pts"),
    )
    out = seen.hint("merge").join(jobs.select("job_id", "pts_in", "pts_out", step.alias("step")), "job_id")
    off = F.greatest(F.col("most") - F.col("step"), F.col("step") - F.col("least"))
    out = out.withColumn("even", F.coalesce(off <= 1, F.lit(True)))
    short = F.col("pts_out") - F.col("last_pts")
    return out.select(
        "job_id",
        "frames",
        "even",
        (F.col("first_pts") == F.col("pts_in")).alias("starts"),
        ((short >= 0) & (short <= F.col("step") + 1)).alias("spans"),
    )


def detect_vfr(streams: DataFrame) -> DataFrame:
    """Adds ``is_vfr``: the declared and the average rate differ.

    ``streams(r_num, r_den, avg_num, avg_den)``; an unset rate (a zero part) decides nothing.
    """
    known = (F.col("r_num") != 0) & (F.col("r_den") != 0) & (F.col("avg_num") != 0) & (F.col("avg_den") != 0)
    differ = wide("r_num") * wide("avg_den") != wide("avg_num") * wide("r_den")
    return streams.withColumn("is_vfr", F.coalesce(known & differ, F.lit(False)))


def packet_steps(packets: DataFrame) -> DataFrame:
    """Smallest and largest distance between neighbouring stamps of a source."""
    stamps = packets.select("source_id", "pts").distinct()
    prev = chunked_scan(stamps, ["source_id"], "pts", [Scan("before", "last", F.col("pts"), inclusive=False)])
    gap = F.col("pts") - F.col("before")
    out = prev.groupBy("source_id").agg(F.min(gap).alias("min_step"), F.max(gap).alias("max_step"))
    return out.withColumn("is_vfr", F.coalesce(F.col("min_step") != F.col("max_step"), F.lit(False)))


def gaussian_weights(radius: float, sigma: float) -> list[float]:
    """Kernel from -r to r; radius held to 1..64, sigma to at least 0.5."""
    r = int(min(max(radius, 1.0), 64.0))
    s = max(sigma, 0.5)
    return [math.exp(-(i * i) / (2.0 * s * s)) for i in range(-r, r + 1)]


def map_lines(
    pixels: DataFrame, change: Callable[[pa.Table, np.ndarray], pa.Table], axis: str, picture: Sequence[str] = ("frame_id",)
) -> DataFrame:
    """``change`` of whole picture lines along ``axis`` ('x' or 'y'), many at a time.

    It gets rows of whole lines, each in order, and where each line starts, and returns as many
    rows with the same columns. Lines are dealt to tasks by picture and line, so the unit
    of work is one line, and a task holds an Arrow batch and a line at once.
    """
    along, across = ("x", "y") if axis == "x" else ("y", "x")
    line_keys = [*picture, across]

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for key in line_keys:
            v = t[key].to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(np.concatenate([[True], change]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by line; a line cut by a batch end waits for the next batch.
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            t = part if rest is None else pa.concat_tables([rest, part])
            if not t.num_rows:
                continue
            first = starts(t)
            cut = int(first[-1])
            if cut:
                yield from change(t.slice(0, cut), first[:-1]).to_batches()
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from change(rest, starts(rest)).to_batches()

    lines = pixels.repartition(*line_keys).sortWithinPartitions(*line_keys, along)
    return lines.mapInArrow(run, pixels.schema)


def gaussian_lines(
    pixels: DataFrame, radius: float | str, sigma: float | str, axis: str, picture: Sequence[str] = ("frame_id",)
) -> DataFrame:
    """One blur pass along ``axis`` ('x' or 'y') with the line's ends repeated.

    Radius and sigma are numbers or columns constant over a picture; a NULL radius
    leaves the picture alone. The unit of work is one picture line.
    """

    def param(t: pa.Table, value: float | str) -> np.ndarray:
        if isinstance(value, str):
            return t[value].cast(pa.float64()).fill_null(float("nan")).to_numpy()
        return np.full(t.num_rows, float(value))

    def blurred(t: pa.Table, first: np.ndarray) -> pa.Table:
        last = np.concatenate([first[1:], [t.num_rows]]) - 1
        lo, hi = (np.repeat(e, last - first + 1) for e in (first, last))
        radii, sigmas = param(t, radius), param(t, sigma)
        kernels = {(r, s) for r, s in zip(radii[first], sigmas[first]) if r == r}
        columns = {}
        for c in ("r", "g", "b", "a"):
            v = t[c].to_numpy()
            out = np.array(v, copy=True)
            for r, s in kernels:
                rows = np.flatnonzero((radii == r) & (sigmas == s))
                weights = gaussian_weights(r, s)
                half = len(weights) // 2
                acc = np.zeros(len(rows))
                for i, w in enumerate(weights):
                    acc += w * v[np.clip(rows + (i - half), lo[rows], hi[rows])]
                out[rows] = acc / max(sum(weights), 1e-5)
            columns[c] = pa.array(out)
        keep = {n: t[n] for n in t.column_names if n not in columns}
        return pa.table({**keep, **columns}).select(t.column_names)

    return map_lines(pixels, blurred, axis, picture)
