"""Structured Streaming queries over the live feeds.

Each function maps a stream to a stream; sources, sinks and triggers stay with the
caller. Rows later than the watermark are dropped and show up in the query progress;
re-running the batch operator of the same name corrects for them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutlake.functions.arith import idiv
from cutlake.functions.timebase import ticks_to_ns
from cutlake.operators.timejobs import classify_presentation

# The driver starts state processors in a process that shipped files don't reach: send them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_state_store(spark: SparkSession) -> None:
    """State kept in RocksDB, which the processors with timers need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _sync(stream: DataFrame, delay: str) -> DataFrame:
    error = ticks_to_ns(F.col("video_pts") - F.col("audio_pts"))
    return stream.withWatermark("ts", delay).withColumn("error_ns", error)


def _rms() -> Column:
    e = F.col("error_ns").cast("double")
    return F.sqrt(F.avg(e * e))


def _bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def sync_monitor(stream: DataFrame, width: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """A/V sync error per session and tumbling window."""
    out = _sync(stream, delay).groupBy(F.window("ts", width), "session_id").agg(
        F.count(F.lit(1)).alias("pairs"), _rms().alias("rms_ns"), F.max(F.abs("error_ns")).alias("max_ns")
    )
    return _bounds(out)


def sync_histogram_monitor(stream: DataFrame, width: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """Pairs per 1 ms error bin, session and tumbling window."""
    bins = _sync(stream, delay).withColumn("bin_ms", idiv(F.col("error_ns"), F.lit(1_000_000)))
    out = bins.groupBy(F.window("ts", width), "session_id", "bin_ms").agg(F.count(F.lit(1)).alias("pairs"))
    return _bounds(out)


def drift_trend(
    stream: DataFrame, width: str = "60 seconds", step: str = "10 seconds", delay: str = "30 seconds"
) -> DataFrame:
    """RMS sync error per session over a sliding window."""
    out = _sync(stream, delay).groupBy(F.window("ts", width, step), "session_id").agg(
        F.count(F.lit(1)).alias("pairs"), _rms().alias("rms_ns")
    )
    return _bounds(out)


class _Baseline(StatefulProcessor):
    """Mean of a session's earlier windows, forgotten once the watermark is ``keep_ms`` past the last of them."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One row per window that has closed since the last batch; later batches hold later windows.
        windows = pd.concat(list(rows)).sort_values("window_start")
        n, total = self.seen.get() if self.seen.exists() else (0, 0.0)
        earlier = n + np.arange(len(windows))
        sums = total + windows["rms_ns"].cumsum() - windows["rms_ns"]
        base = np.where(earlier > 0, sums / np.maximum(earlier, 1), np.nan)
        ratio = np.where(base > 0, windows["rms_ns"] / np.where(base > 0, base, 1.0), np.nan)
        self.seen.update((int(n + len(windows)), float(total + windows["rms_ns"].sum())))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(windows["end_ms"].iloc[-1]) + self.keep_ms)
        known = windows[["window_start", "window_end", "session_id", "pairs", "rms_ns"]].assign(earlier=earlier)
        blank = lambda values: pd.Series(values, dtype="float64").astype("object").where(~np.isnan(values), None)
        yield known.reset_index(drop=True).assign(baseline_ns=blank(base), ratio=blank(ratio))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())


def drift_against_baseline(
    stream: DataFrame, width: str = "60 seconds", step: str = "10 seconds", delay: str = "30 seconds", keep_s: int = 86_400
) -> DataFrame:
    """``drift_trend`` with each window's ratio to the mean of the session's earlier windows.

    ``earlier`` counts those; a first window, or one after only silent ones, has no ratio. A
    session that closes no window for ``keep_s`` seconds of event time starts anew.
    """
    windows = drift_trend(stream, width, step, delay).withColumn("end_ms", F.unix_millis("window_end"))
    return windows.groupBy("session_id").transformWithStateInPandas(
        _Baseline(keep_s * 1000),
        "window_start timestamp, window_end timestamp, session_id bigint, pairs bigint, rms_ns double, earlier bigint, baseline_ns double, ratio double",
        "Append",
        "EventTime",
    )


def playback_sessions(stream: DataFrame, gap: str, vsync_ns: int, delay: str = "30 seconds") -> DataFrame:
    """Stretches of playback without a pause of ``gap``, with what became of the frames.

    ``stream(session_id, ts, frame_pts, clock_pts, fps_num, fps_den)``.
    """
    judged = classify_presentation(stream.withWatermark("ts", delay), vsync_ns)

    def n(action: str) -> Column:
        return F.sum((F.col("action") == action).cast("bigint"))

    out = judged.groupBy(F.session_window("ts", gap), "session_id").agg(
        n("Present").alias("presented"), n("Hold").alias("held"), n("Drop").alias("dropped")
    )
    return out.withColumns(
        {"session_start": F.col("session_window.start"), "session_end": F.col("session_window.end")}
    ).drop("session_window")


def stage_monitor(stream: DataFrame, width: str = "1 minute", delay: str = "30 seconds") -> DataFrame:
    """Stage times per run and window; percentiles are approximate here, exact in batch."""
    out = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "run_id", "stage").agg(
        F.count(F.lit(1)).alias("count"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.avg("ms").alias("avg_ms"), F.percentile_approx("ms", 0.95).alias("p95_ms"),
        F.percentile_approx("ms", 0.99).alias("p99_ms"),
    )
    return _bounds(out)


TERMINAL_PHASES = ("Cancelled", "Done", "Failed")


class _Progress(StatefulProcessor):
    """Latest state of one export job; a timer reports it as stalled.

    Jobs have few rows a batch, so these come as they are: a pandas table per job cost more than its rows.
    """

    def __init__(self, stall_ms: int) -> None:
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long, frames_done long, total_frames long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((r for r in rows if r.ts_ms is not None), key=lambda r: r.ts_ms, default=None)
        known = self.last.get()
        if newest is None or known is not None and newest.ts_ms <= known[0]:
            return
        done, total, secs = int(newest.frames_done), int(newest.total_frames), float(newest.elapsed_s)
        fps = done / secs if secs > 0 else 0.0
        estimable = 5 <= done < total and not (secs > 0 and fps < 0.001)
        eta = ((total - done) / fps if fps > 0 else 0.0) if estimable else None
        if known is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if newest.phase not in TERMINAL_PHASES:
            self.last.update((newest.ts_ms, done, total))
            self.handle.registerTimer(newest.ts_ms + self.stall_ms)
        elif known is not None:
            self.last.clear()
        yield Row(job_id=key[0], ts_ms=newest.ts_ms, frames_done=done, total_frames=total, fps=fps, eta_s=eta, status=newest.phase)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None:
            ts, done, total = known
            yield Row(job_id=key[0], ts_ms=ts, frames_done=done, total_frames=total, fps=None, eta_s=None, status="Stalled")


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest row of each job of a batch; of equal ones the first."""
    for batch in batches:
        ts = batch.column("ts").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        job = batch.column("job_id").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ts[::-1], job[::-1]))
        last = np.append(np.diff(job[::-1][order]) != 0, True)[: len(order)]
        yield batch.take(pa.array(np.sort(len(ts) - 1 - order[last])))


def _millis(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))


def progress_monitor(stream: DataFrame, stall_s: int, delay: str = "30 seconds") -> DataFrame:
    """Latest progress per export job and batch, with rate and remaining time.

    ``stream(job_id, ts, frames_done, total_frames, elapsed_s, phase)``. A terminal
    phase forgets the job; silence for ``stall_s`` reports it once as Stalled. Tasks drop what is older
    than a job's newest row before the shuffle: only that row counts, and it is late only if all are.
    """
    newest = stream.mapInArrow(_newest, stream.schema)
    return _millis(newest, delay).groupBy("job_id").transformWithState(
        _Progress(stall_s * 1000),
        "job_id bigint, ts_ms bigint, frames_done bigint, total_frames bigint, fps double, eta_s double, status string",
        "Append",
        "EventTime",
    )


class _Debounce(StatefulProcessor):
    """Newest snapshot of one path, released once it has been dirty long enough."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "dirty_ms long, version_ms long, json string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = held = self.pending.get()
        for r in sorted((r for r in rows if r.ts_ms is not None), key=lambda r: r.ts_ms):
            if held is not None and r.ts_ms >= held[0] + self.wait_ms:
                yield Row(path=key[0], version_ms=held[1], json=held[2])
                held = None
            if held is None:
                held = (r.ts_ms, r.ts_ms, r.json)
            elif r.ts_ms >= held[1]:
                held = (held[0], r.ts_ms, r.json)
        if held is None or held == known:
            return
        if known is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.pending.update(held)
        self.handle.registerTimer(held[0] + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.pending.get()
        if known is not None:
            self.pending.clear()
            yield Row(path=key[0], version_ms=known[1], json=known[2])


def debounced_snapshots(stream: DataFrame, wait_s: int = 30, delay: str = "10 seconds") -> DataFrame:
    """The newest version of each path once it has been dirty for ``wait_s``.

    ``stream(path, ts, json)``; the result (path, version_ts, json) feeds the newest-wins
    snapshot sink.
    """
    settled = _millis(stream, delay).groupBy("path").transformWithState(
        _Debounce(wait_s * 1000), "path string, version_ms bigint, json string", "Append", "EventTime"
    )
    return settled.select("path", F.timestamp_millis("version_ms").alias("version_ts"), "json")


def pair_av(video: DataFrame, audio: DataFrame, bound: str, delay: str = "30 seconds") -> DataFrame:
    """Video and audio stamps of a session within ``bound`` of each other.

    ``video(session_id, ts, video_pts)``, ``audio(session_id, ts, audio_pts)``.
    """
    v = video.withWatermark("ts", delay).withColumnRenamed("ts", "video_ts")
    a = audio.withWatermark("ts", delay).select(F.col("session_id").alias("__s"), F.col("ts").alias("audio_ts"), "audio_pts")
    near = F.col("audio_ts").between(
        F.col("video_ts") - F.expr(f"INTERVAL {bound}"), F.col("video_ts") + F.expr(f"INTERVAL {bound}")
    )
    return v.join(a, (F.col("session_id") == F.col("__s")) & near).drop("__s")


def dedupe_packets(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each packet once, however often it is re-sent within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_id", "stream_index", "seq"])


class _Monotonic(StatefulProcessor):
    """Keeps the last stamp of one stream and lifts later ones above it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "dts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        n = np.arange(1, len(batch) + 1)
        lead = batch["dts"].to_numpy() - n
        if self.last.exists():
            lead[0] = max(lead[0], self.last.get()[0])  # first must exceed the last stamp
        dts = np.maximum.accumulate(lead) + n
        self.last.update((int(dts[-1]),))
        yield batch[["stream_id", "seq"]].assign(dts=dts)


def repair_dts_stream(stream: DataFrame) -> DataFrame:
    """Strictly increasing ``dts`` per ``stream_id``, across batches.

    ``stream(stream_id, seq, dts)``; a batch is put in ``seq`` order first.
    """
    return stream.groupBy("stream_id").transformWithStateInPandas(
        _Monotonic(), "stream_id bigint, seq bigint, dts bigint", "Append", "None"
    )

