"""Grouped statistics: frame timing reports, repeats, sync error, storage, loudness peaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.arith import idiv, ratio
from cutlake.functions.timebase import frame_at_trunc, ticks_to_ns
from cutlake.operators.quantiles import (
    median_of,
    nearest_rank,
    order_statistics,
    spread_out,
    stacked,
    upper_median_rank,
)
from cutlake.operators.scan import Scan, chunked_scan, ranked

# Stages that only break another stage down.
BREAKDOWN_STAGES = ("UploadPrepare", "UploadSubmit")


def frame_totals(frame_stages: DataFrame) -> DataFrame:
    """CPU time per (run, frame), parents counted once."""
    cpu = (F.col("clock") == "cpu") & ~F.col("stage").isin(*BREAKDOWN_STAGES)
    return frame_stages.groupBy("run_id", "frame_index").agg(
        F.coalesce(F.sum(F.when(cpu, F.col("ms"))), F.lit(0.0)).alias("total_ms")
    )


def stage_stats(frame_stages: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per run and stage: CPU count/min/max/avg/p95/p99/total/share and GPU avg/p95/p99.

    A frame without a CPU reading counts as 0 ms; one without a GPU reading does not
    count at all. The zero frames are never materialised: they only shift the ranks.
    """
    listed = frame_stages.where(F.col("stage").isin(*stages))
    per_frame = listed.groupBy("run_id", "frame_index", "stage", "clock").agg(F.sum("ms").alias("ms"))
    frames = frame_stages.select("run_id", "frame_index").distinct().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("frames")
    )
    grid = frames.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))

    measured = per_frame.groupBy("run_id", "stage").agg(
        *[
            fn(F.when(F.col("clock") == clock, F.col("ms"))).alias(name)
            for clock, fn, name in (
                ("cpu", F.count, "seen"), ("cpu", F.min, "lo"), ("cpu", F.max, "hi"), ("cpu", F.sum, "sum"),
                ("gpu", F.avg, "gpu_avg_ms"),
            )
        ]
    )
    # Rank r among the dense CPU series is rank r - zeros among the measured frames.
    dense = per_frame.join(frames.withColumnRenamed("frames", "__f"), "run_id")
    ranks = {}
    for name, p in (("p95", 0.95), ("p99", 0.99)):
        dense_rank = F.ceil(F.col("__f") * F.lit(p)) - (F.col("__f") - F.col("n"))
        ranks[name] = F.when(F.col("clock") == "cpu", dense_rank).otherwise(nearest_rank(p))
    tails = order_statistics(dense, ["run_id", "stage", "clock", "__f"], "ms", ranks)
    tails = tails.groupBy("run_id", "stage").agg(
        *[
            F.max(F.when(F.col("clock") == clock, F.col(p))).alias(name)
            for clock, p, name in (
                ("cpu", "p95", "p95"), ("cpu", "p99", "p99"), ("gpu", "p95", "gpu_p95_ms"), ("gpu", "p99", "gpu_p99_ms"),
            )
        ]
    )
    run_total = frame_totals(frame_stages).groupBy("run_id").agg(F.sum("total_ms").alias("run_ms"))

    key = ["run_id", "stage"]
    out = grid.join(measured, key, "left").join(tails, key, "left").join(run_total, "run_id")
    zero = F.lit(0.0)
    complete = F.coalesce("seen", F.lit(0)) == F.col("frames")
    total = F.coalesce("sum", zero)
    return out.select(
        *key,
        F.col("frames").alias("count"),
        F.when(complete, F.col("lo")).otherwise(zero).alias("min_ms"),
        F.coalesce("hi", zero).alias("max_ms"),
        (total / F.col("frames")).alias("avg_ms"),
        F.coalesce("p95", zero).alias("p95_ms"),
        F.coalesce("p99", zero).alias("p99_ms"),
        total.alias("total_ms"),
        F.coalesce(ratio(total * 100, F.nullif("run_ms", zero)), zero).alias("share_pct"),
        "gpu_avg_ms",
        "gpu_p95_ms",
        "gpu_p99_ms",
    )


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, min, max, avg, p95, p99 and total of the non-NULL values per key."""
    keys = list(keys)
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        F.avg(value).alias("avg_ms"), F.sum(value).alias("total_ms"),
    )
    tails = order_statistics(df, keys, value, {"p95_ms": nearest_rank(0.95), "p99_ms": nearest_rank(0.99)})
    return sums.join(tails.drop("n"), keys)


def run_summary(runs: DataFrame, totals: DataFrame, latency: DataFrame) -> DataFrame:
    """Rates of each run from its wall time, CPU totals and frame intervals.

    ``runs(run_id, wall_s, target_fps)``; a rate over nothing is 0, as in a report,
    but ``latency_fps`` stays NULL when no interval was stamped.
    """
    cpu = distribution(totals, ["run_id"], "total_ms").select(
        "run_id", F.col("count").alias("frames"), F.col("avg_ms").alias("cpu_avg_ms"), F.col("p99_ms").alias("cpu_p99_ms")
    )
    lat = latency.groupBy("run_id").agg(F.avg("latency_ms").alias("latency_avg_ms"))
    out = runs.join(cpu, "run_id", "left").join(lat, "run_id", "left")

    def rate(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den)

    wall, frames = F.col("wall_s"), F.coalesce("frames", F.lit(0))
    fps = F.coalesce(rate(frames, wall), F.lit(0.0))
    implied = rate(F.lit(1000.0), F.col("latency_avg_ms"))
    return out.select(
        "run_id",
        frames.alias("frames"),
        fps.alias("average_fps"),
        F.coalesce(rate(F.lit(1000.0), F.col("cpu_avg_ms")), F.lit(0.0)).alias("cpu_bound_fps"),
        F.coalesce(rate(F.lit(1000.0), F.col("cpu_p99_ms")), F.lit(0.0)).alias("p99_fps"),
        F.coalesce(rate(frames / F.col("target_fps"), wall), F.lit(0.0)).alias("realtime_factor"),
        implied.alias("latency_fps"),
        (F.abs(implied - fps) > fps * F.lit(0.1)).alias("latency_disagrees"),
    )


def _stamped(latency: DataFrame) -> DataFrame:
    """Frames carrying an interval, numbered from 1 in frame order per run."""
    return ranked(
        latency.where(F.col("latency_ms").isNotNull()), ["run_id"], "frame_index", "frame_index", "nth"
    )


def latency_split(latency: DataFrame) -> DataFrame:
    """First stamped interval (the fill) apart from the steady rest of each run."""
    stamped = _stamped(latency)
    fill = stamped.where("nth = 1").select("run_id", F.col("latency_ms").alias("fill_ms"))
    steady = distribution(stamped.where("nth > 1"), ["run_id"], "latency_ms")
    names = [(c, f"steady_{c}") for c in ("count", "min_ms", "max_ms", "avg_ms", "p95_ms", "p99_ms")]
    return fill.join(steady, "run_id", "left").select(
        "run_id", "fill_ms", *[F.col(a).alias(b) for a, b in names]
    )


def latency_alternation(latency: DataFrame) -> DataFrame:
    """Mean steady interval of even and odd frames; NULL below five stamps.

    ``gap_pct`` is the difference relative to the smaller mean.
    """
    even = F.col("nth") % 2 == 0  # the steady series starts at nth = 2
    steady = F.col("nth") > 1
    out = _stamped(latency).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stamped"),
        F.avg(F.when(steady & even, F.col("latency_ms"))).alias("e"),
        F.avg(F.when(steady & ~even, F.col("latency_ms"))).alias("o"),
    )
    enough = F.col("stamped") >= 5
    lo, hi = F.least("e", "o"), F.greatest("e", "o")
    return out.select(
        "run_id",
        "stamped",
        F.when(enough, F.col("e")).alias("even_ms"),
        F.when(enough, F.col("o")).alias("odd_ms"),
        F.when(enough & (lo > 0), (hi - lo) / lo * 100).alias("gap_pct"),
    )


def mad_thresholds(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Outlier limit per key: upper median + 3 scaled MADs, or twice a flat median."""
    by = list(by)
    med = order_statistics(df, by, value, {"med": upper_median_rank()}).drop("n")
    dev = df.join(med, by).withColumn("__dev", F.abs(F.col(value) - F.col("med")))
    mad = order_statistics(dev, by, "__dev", {"mad": upper_median_rank()})
    limit = F.when(F.col("mad") > 0, F.col("med") + F.lit(3.0 * 1.4826) * F.col("mad")).otherwise(
        F.col("med") * 2
    )
    return med.join(mad, by).withColumn("threshold", limit)


def mad_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows strictly above their key's outlier limit, with the limit."""
    limits = mad_thresholds(df, value, by).select(*by, "threshold")
    return df.join(limits, list(by)).where(F.col(value) > F.col("threshold"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Correlation per key over rows with both values; NULL below 3 or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.where(both).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(x, y).alias("c"),
        F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"),
    )
    usable = (F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0)
    r = F.when(usable, F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return out.select(*by, "n", r.alias("r"))


def outlier_overlap(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Sizes of the outlier sets of two measures and of their intersection, per key."""
    by = list(by)
    # Both measures go through one threshold computation.
    limits = mad_thresholds(stacked(df, by, [a, b]), "value", [*by, "what"])
    limits = spread_out(limits, by, "threshold", {a: "__ta", b: "__tb"})
    is_a, is_b = F.col(a) > F.col("__ta"), F.col(b) > F.col("__tb")

    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))

    return df.join(limits, by).groupBy(*by).agg(
        n(is_a).alias("n_a"), n(is_b).alias("n_b"), n(is_a & is_b).alias("n_both")
    )


def repeat_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeats of one job reduced to medians, with the FPS spread and the memory peak.

    ``runs(by, frames, seconds, input_seconds, bytes, peak_bytes)``. Each rate is
    formed per run first and is NULL where its divisor is not positive.
    """
    by = list(by)

    def when_pos(num: Column, *divisors: Column) -> Column:
        ok = divisors[0] > 0
        for d in divisors[1:]:
            ok = ok & (d > 0)
        return F.when(ok, num)

    s, inp = F.col("seconds"), F.col("input_seconds")
    rated = runs.withColumns(
        {
            "fps": when_pos(ratio(F.col("frames"), F.nullif(s, F.lit(0.0))), s, F.col("frames")),
            "realtime": when_pos(ratio(inp, F.nullif(s, F.lit(0.0))), s, inp),
            "bitrate": when_pos(ratio(F.col("bytes") * 8, F.nullif(inp, F.lit(0.0))), inp, F.col("bytes")),
        }
    )
    out = rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.max("peak_bytes").alias("peak_bytes"), F.count("fps").alias("__n"),
        F.min("fps").alias("__lo"), F.max("fps").alias("__hi"),
    )
    names = {
        "seconds": "median_seconds", "realtime": "median_realtime", "bitrate": "median_bitrate_bps", "fps": "median_fps",
    }
    medians = median_of(stacked(rated, by, list(names)), [*by, "what"], "value")
    out = out.join(spread_out(medians, by, "median", names), by, "left")
    spread = (F.col("__hi") - F.col("__lo")) / F.col("median_fps") * 100
    usable = (F.col("__n") >= 2) & (F.col("median_fps") > 0)
    return out.withColumn("fps_spread_pct", F.when(usable, spread)).drop("__n", "__lo", "__hi")


SPREAD_WARN_PCT = 10.0


def _node_frames(brackets: DataFrame, key: Sequence[str]) -> DataFrame:
    return brackets.groupBy(*key, "frame").agg(F.sum("ms").alias("value")).drop("frame")


def node_frame_totals(brackets: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per node: the median frame total of ``node_timings`` alone, which needs no instances."""
    key = [*by, "node"]
    return median_of(_node_frames(brackets, key), key, "value", "frame_total_ms").drop("n")


def node_timings(brackets: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per node: pooled median, median frame total, per-instance spread and a warning.

    ``brackets(by, frame, seq, node, ms)``; the n-th bracket of a node within a frame
    is its n-th instance. The window is one frame's brackets of one node.
    """
    by = list(by)
    nth = F.row_number().over(Window.partitionBy(*by, "frame", "node").orderBy("seq"))
    numbered = brackets.withColumn("instance", nth)
    key = [*by, "node"]
    # Single brackets, frame totals and the brackets of each instance in one pass.
    series = numbered.select(
        *key, F.col("ms").alias("value"),
        F.explode(F.array(F.lit(0), F.col("instance"))).alias("what"),
    )
    per_frame = _node_frames(numbered, key).withColumn("what", F.lit(-1))
    med = median_of(series.unionByName(per_frame), [*key, "what"], "value")

    def pick(which: Column, value: str) -> Column:
        return F.max(F.when(which, F.col(value)))

    pooled = med.groupBy(*key).agg(
        pick(F.col("what") == 0, "n").alias("samples"),
        pick(F.col("what") == 0, "median").alias("median_ms"),
        pick(F.col("what") == -1, "median").alias("frame_total_ms"),
        pick(F.col("what") > 0, "median").alias("__hi"),
        F.min(F.when(F.col("what") > 0, F.col("median"))).alias("__lo"),
        # At most one value per bracket of a frame: an exact median in place.
        F.median(F.when(F.col("what") > 0, F.col("median"))).alias("__mid"),
        F.count(F.when(F.col("what") > 0, F.col("median"))).alias("per_frame"),
    )
    pct = F.when(
        (F.col("per_frame") >= 2) & (F.col("__mid") > 0), (F.col("__hi") - F.col("__lo")) / F.col("__mid") * 100
    )
    out = pooled.where("per_frame > 0").withColumn("instance_spread_pct", pct).drop("__hi", "__lo", "__mid")
    return out.withColumn("uneven", F.coalesce(F.col("instance_spread_pct") > SPREAD_WARN_PCT, F.lit(False)))


def transfer_metrics(stage_stats: DataFrame, latency: DataFrame, uploads: DataFrame) -> DataFrame:
    """GPU time as a share of the frame interval, and the upload rate it implies.

    ``uploads(run_id, upload_bytes, frames)``.
    """
    gpu = stage_stats.groupBy("run_id").agg(
        F.sum("gpu_avg_ms").alias("gpu_ms"),
        F.max(F.when(F.col("stage") == "GpuTransfer", F.col("gpu_avg_ms"))).alias("transfer_ms"),
    )
    lat = latency.groupBy("run_id").agg(F.avg("latency_ms").alias("lat_ms"))
    out = gpu.join(lat, "run_id", "left").join(uploads, "run_id", "left")
    pct = F.when((F.col("lat_ms") > 0) & (F.col("gpu_ms") > 0), F.col("gpu_ms") / F.col("lat_ms") * 100)
    per_frame = ratio(F.col("upload_bytes"), F.nullif(F.col("frames"), F.lit(0)))
    rate = F.when(F.col("transfer_ms") > 0, per_frame / (F.col("transfer_ms") / 1000) / 1e9)
    return out.select("run_id", pct.alias("gpu_consistency_pct"), rate.alias("transfer_gbps"))


def sync_errors(av_samples: DataFrame) -> DataFrame:
    """Adds ``error_ns``: video minus audio time of each presented pair."""
    return av_samples.withColumn("error_ns", ticks_to_ns(F.col("video_pts") - F.col("audio_pts")))


def _rms(value: Column) -> Column:
    d = value.cast("double")
    return F.sqrt(F.avg(d * d))


def sync_stats(av_samples: DataFrame) -> DataFrame:
    """A/V sync per session: RMS and largest error, halves, first and last offset."""
    e = sync_errors(av_samples).withColumn("__tick", F.unix_micros(F.col("ts").cast("timestamp")))
    e = ranked(e, ["session_id"], "__tick", "video_pts", "nth", cell=1 << 28)
    n = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"))
    err, first = F.col("error_ns"), F.col("nth") * 2 <= F.col("pairs")
    return e.join(n, "session_id").groupBy("session_id").agg(
        F.max("pairs").alias("pairs"),
        _rms(err).alias("rms_ns"),
        F.max(F.abs(err)).alias("max_ns"),
        _rms(F.when(first, err)).alias("first_half_rms_ns"),
        _rms(F.when(~first, err)).alias("second_half_rms_ns"),
        F.min_by("error_ns", "nth").alias("start_ns"),
        F.max_by("error_ns", "nth").alias("end_ns"),
    )


def sync_histogram(av_samples: DataFrame) -> DataFrame:
    """Pairs per 1 ms error bin; truncation makes bin 0 span both signs."""
    bins = sync_errors(av_samples).withColumn("bin_ms", idiv(F.col("error_ns"), F.lit(1_000_000)))
    return bins.groupBy("session_id", "bin_ms").agg(F.count(F.lit(1)).alias("pairs"))


def project_duration(clips: DataFrame, projects: DataFrame) -> DataFrame:
    """Length of each project in frames; 0 for one without clips."""
    end = clips.groupBy("project_id").agg(F.max("pts_out").alias("end_pts"))
    frames = frame_at_trunc(F.col("end_pts"), F.col("fps_num"), F.col("fps_den"))
    return projects.join(end, "project_id", "left").select(
        "project_id", F.coalesce("end_pts", F.lit(0)).alias("end_pts"), F.coalesce(frames, F.lit(0)).alias("frames")
    )


def peak_overlap(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Per key: how many closed intervals there are and how many live at once at most."""
    keys = list(keys)
    steps = intervals.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
                F.struct((F.greatest(start, end) + 1).alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("s"),
    )
    net = steps.groupBy(*keys, F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d"))
    live = chunked_scan(net, keys, "t", [Scan("live", "sum", F.col("d"))])
    peaks = live.groupBy(*keys).agg(F.max("live").alias("ideal"))
    return intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).join(peaks, keys)


def waveform_peaks(samples: DataFrame, per_peak: int = 40) -> DataFrame:
    """Largest absolute sample of each run of ``per_peak``; a short tail counts too."""
    at = idiv(F.col("sample_idx"), F.lit(per_peak).cast("bigint"))
    size = F.abs((F.col("left") + F.col("right")) / 2)
    return samples.groupBy("source_id", at.alias("peak_idx")).agg(F.max(size).alias("peak"))


def additive_linearity(solo: DataFrame, combined: DataFrame) -> DataFrame:
    """Observed cost of running members together over the sum of their solo medians.

    ``solo(member, ms)``, ``combined(group_id, member, observed_ms)``; NULL when any
    member has no solo reading.
    """
    med = order_statistics(solo, ["member"], "ms", {"solo_ms": upper_median_rank()}).drop("n")
    out = combined.join(med, "member", "left").groupBy("group_id").agg(
        F.max("observed_ms").alias("observed_ms"),
        F.when(F.count("solo_ms") == F.count(F.lit(1)), F.sum("solo_ms")).alias("additive_ms"),
    )
    linear = F.when(F.col("additive_ms") > 0, F.col("observed_ms") / F.col("additive_ms"))
    return out.withColumn("linearity", linear)


def decode_manifest(frames: DataFrame) -> DataFrame:
    """Distinct source pictures a render needs, each with the first frame that needs it.

    One row per picture, so a source of any length stays spread over tasks.
    """
    once = frames.groupBy("source_id", "quantised_pts").agg(F.min("frame_index").alias("frame_index"))
    return once


def _plane_bytes() -> Column:
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    px = w * h
    planar = px + idiv(w + 1, F.lit(2)) * idiv(h + 1, F.lit(2)) * 2
    # Bytes of one frame per pixel format.
    sizes: Mapping[str, Column] = {
        "Yuv420p": planar, "Yuv422p": px * 2, "Yuv444p": px * 3, "Nv12": planar, "P010": planar * 2,
        "Yuv420p10": planar * 2, "Yuv422p10": px * 4, "Yuv444p10": px * 6, "Yuv420p12": planar * 2,
        "Yuv444p12": px * 6, "Rgba8": px * 4, "Rgba16f": px * 8,
    }
    out = F
    for fmt, size in sizes.items():
        out = out.when(F.col("pixel_fmt") == fmt, size)
    return out


def storage_estimate(sources: DataFrame) -> DataFrame:
    """Bytes of one decoded frame, rounded up to 256, totalled by project and format."""
    padded = idiv(_plane_bytes() + 255, F.lit(256)) * 256
    sized = sources.withColumn("frame_bytes", padded)
    return sized.rollup("project_id", "pixel_fmt").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("frame_bytes").alias("frame_bytes")
    )


def miss_rate(counters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of acquisitions that missed; NULL when there were none."""
    out = counters.groupBy(*by).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    total = F.nullif(F.col("hits") + F.col("misses"), F.lit(0))
    return out.withColumn("miss_rate", ratio(F.col("misses"), total))


def light_levels(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Content light level: brightest pixel and brightest frame average, in nits.

    ``pixels(by, frame_id, nits)`` with the brightest component of each pixel.
    """
    frames = pixels.groupBy(*by, "frame_id").agg(F.max("nits").alias("peak"), F.avg("nits").alias("mean"))
    return frames.groupBy(*by).agg(F.max("peak").alias("max_cll"), F.max("mean").alias("max_fall"))
