"""Queries: streaming monitors (r*), run to completion over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.plans.derived import EPOCH
from cutlake.plans.registry import REGISTRY, Lib
from cutlake.session import scratch_dir
from cutlake.streaming import monitors

q = REGISTRY.add


def events(lib: Lib, *exprs: str) -> DataFrame:
    """The event files as a stream, with ``ts`` as a UTC timestamp."""
    raw = (
        lib.spark.readStream.schema(lib.raw("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(lib.sf_dir)
    )
    return raw.selectExpr("cast(ts AS timestamp) AS ts", *exprs)


def drained(lib: Lib, stream: DataFrame, name: str) -> DataFrame:
    """Everything the stream emits for the files there are, as a table."""
    target = scratch_dir(lib.spark, name)
    run = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", f"{target}-log")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return lib.spark.read.schema(stream.schema).parquet(target)


_AV = (
    "user_id AS session_id", f"(unix_micros(cast(ts AS timestamp)) - {EPOCH})*9 div 100 AS video_pts",
    f"(unix_micros(cast(ts AS timestamp)) - {EPOCH})*9 div 100 - (cast(floor(value*100) AS bigint) - 5000) AS audio_pts",
)
_ERR = "ev AS (SELECT session_id, ts, (video_pts - audio_pts) * 1000000000 // 90000 AS e FROM av_samples)"


def _closed(end: str, delay_s: int) -> str:
    return f"{end} <= (SELECT max(ts) - INTERVAL {delay_s} SECOND FROM events)"


def _win(seconds: int) -> str:
    return f"make_timestamp(epoch_us(ts) // {seconds * 1000000} * {seconds * 1000000})"


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@q("r1_sync_monitor", "av_samples",
   f"SELECT * FROM (SELECT {_win(3600)} AS window_start, {_win(3600)} + INTERVAL 3600 SECOND AS window_end, session_id, count(*) AS pairs, round(sqrt(avg(CAST(e AS DOUBLE) * e)), 2) AS rms_ns, max(abs(e)) AS max_ns FROM ev GROUP BY ALL) WHERE {_closed('window_end', 30)}", _ERR)
def _(lib):
    out = drained(lib, monitors.sync_monitor(events(lib, *_AV), "3600 seconds"), "r1")
    return _ntz(out.withColumn("rms_ns", rounded(F.col("rms_ns"), 2)), "window_start", "window_end")


@q("r1_sync_histogram_monitor", "av_samples",
   f"SELECT * FROM (SELECT {_win(3600)} AS window_start, {_win(3600)} + INTERVAL 3600 SECOND AS window_end, session_id, e // 1000000 AS bin_ms, count(*) AS pairs FROM ev GROUP BY ALL) WHERE {_closed('window_end', 30)}", _ERR)
def _(lib):
    out = drained(lib, monitors.sync_histogram_monitor(events(lib, *_AV), "3600 seconds"), "r1h")
    return _ntz(out, "window_start", "window_end")


@q("r2_drift_trend", "av_samples",
   f"SELECT * FROM (SELECT w AS window_start, w + INTERVAL 7200 SECOND AS window_end, session_id, count(*) AS pairs, round(sqrt(avg(CAST(e AS DOUBLE) * e)), 2) AS rms_ns FROM (SELECT *, {_win(3600)} - to_seconds(k * 3600) AS w FROM ev, (SELECT unnest(range(2)) AS k)) GROUP BY ALL) WHERE {_closed('window_end', 30)}", _ERR)
def _(lib):
    out = drained(lib, monitors.drift_trend(events(lib, *_AV), "7200 seconds", "3600 seconds"), "r2")
    return _ntz(out.withColumn("rms_ns", rounded(F.col("rms_ns"), 2)), "window_start", "window_end")


# The ratio is to the mean over the windows of the session that started earlier.
_DRIFT = (
    f"dr AS (SELECT * FROM (SELECT w AS window_start, w + INTERVAL 7200 SECOND AS window_end, session_id, count(*) AS pairs, sqrt(avg(CAST(e AS DOUBLE) * e)) AS rms FROM (SELECT *, {_win(3600)} - to_seconds(k * 3600) AS w FROM ev, (SELECT unnest(range(2)) AS k)) GROUP BY ALL) WHERE {_closed('window_end', 30)}), "
    "ba AS (SELECT *, row_number() OVER o - 1 AS earlier, avg(rms) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM dr WINDOW o AS (PARTITION BY session_id ORDER BY window_start))"
)


@q("r2_drift_against_baseline", "av_samples",
   "SELECT window_start, window_end, session_id, pairs, round(rms, 2) AS rms_ns, earlier, round(base, 2) AS baseline_ns, round(CASE WHEN base > 0 THEN rms / base END, 6) AS ratio FROM ba", f"{_ERR}, {_DRIFT}")
def _(lib):
    monitors.use_state_store(lib.spark)
    out = drained(lib, monitors.drift_against_baseline(events(lib, *_AV), "7200 seconds", "3600 seconds", keep_s=10_000_000), "r2b")
    figures = {"rms_ns": rounded(F.col("rms_ns"), 2), "baseline_ns": rounded(F.col("baseline_ns"), 2), "ratio": rounded(F.col("ratio"), 6)}
    return _ntz(out.withColumns(figures), "window_start", "window_end")


@q("r3_playback_sessions", "av_samples",
   "SELECT session_id, min(ts) AS session_start, max(ts) + INTERVAL 7200 SECOND AS session_end, CAST(count(*) FILTER (a = 'p') AS BIGINT) AS presented, CAST(count(*) FILTER (a = 'h') AS BIGINT) AS held, CAST(count(*) FILTER (a = 'd') AS BIGINT) AS dropped FROM "
   "(SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY ts) AS sess, CASE WHEN e < -33366666 THEN 'd' WHEN e > 8333333 THEN 'h' ELSE 'p' END AS a FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS n FROM ev)) "
   f"GROUP BY session_id, sess HAVING {_closed('max(ts) + INTERVAL 7200 SECOND', 30)}", _ERR)
def _(lib):
    feed = events(lib, *_AV).selectExpr(
        "ts", "session_id", "video_pts AS frame_pts", "audio_pts AS clock_pts", "30000L AS fps_num", "1001L AS fps_den"
    )
    out = drained(lib, monitors.playback_sessions(feed, "7200 seconds", 16_666_666), "r3")
    return _ntz(out, "session_start", "session_end")


@q("r4_stage_monitor", "",
   f"SELECT * FROM (SELECT {_win(21600)} AS window_start, {_win(21600)} + INTERVAL 21600 SECOND AS window_end, user_id // 64 AS run_id, event_type AS stage, count(*) AS \"count\", min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS avg_ms, "
   f"quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms FROM events GROUP BY ALL) WHERE {_closed('window_end', 30)}")
def _(lib):
    feed = events(lib, "user_id div 64 AS run_id", "event_type AS stage", "value AS ms")
    out = drained(lib, monitors.stage_monitor(feed, "21600 seconds"), "r4")
    return _ntz(out.withColumn("avg_ms", rounded(F.col("avg_ms"))), "window_start", "window_end")


@q("r5_progress_monitor")
def _(lib):
    monitors.use_state_store(lib.spark)
    feed = events(
        lib, "user_id AS job_id", f"(unix_micros(cast(ts AS timestamp)) - {EPOCH}) div 3600000000 AS frames_done", "720L AS total_frames",
        f"(unix_micros(cast(ts AS timestamp)) - {EPOCH}) / 1e6 AS elapsed_s",
        "CASE WHEN event_type = 'purchase' AND value > 80 THEN 'Done' ELSE 'Rendering' END AS phase",
    )
    return drained(lib, monitors.progress_monitor(feed, stall_s=3600), "r5")


@q("r6_debounced_snapshots")
def _(lib):
    monitors.use_state_store(lib.spark)
    feed = events(lib, "concat('/p/', user_id) AS path", "props AS json")
    return drained(lib, monitors.debounced_snapshots(feed, wait_s=36_000), "r6")


@q("r7_pair_av", "av_samples",
   "SELECT v.user_id AS session_id, v.ts AS video_ts, a.ts AS audio_ts, v.event_id AS video_pts, a.event_id AS audio_pts FROM events v JOIN events a ON v.user_id = a.user_id AND a.ts BETWEEN v.ts - INTERVAL 3600 SECOND AND v.ts + INTERVAL 3600 SECOND "
   "WHERE v.event_type = 'view' AND a.event_type = 'click'")
def _(lib):
    video = events(lib, "user_id AS session_id", "event_id AS video_pts", "event_type").where("event_type = 'view'").drop("event_type")
    audio = events(lib, "user_id AS session_id", "event_id AS audio_pts", "event_type").where("event_type = 'click'").drop("event_type")
    return _ntz(drained(lib, monitors.pair_av(video, audio, "3600 SECONDS"), "r7"), "video_ts", "audio_ts")


@q("r8_dedupe_packets", "", "SELECT user_id AS source_id, event_id AS seq, value AS pts FROM events")
def _(lib):
    resent = events(lib, "user_id AS source_id", "0 AS stream_index", "event_id AS seq", "value AS pts", "explode(array(0, 1, 2)) AS copy")
    out = drained(lib, monitors.dedupe_packets(resent.drop("copy"), "1 day"), "r8")
    return out.select("source_id", "seq", "pts")


@q("r9_repair_dts_stream", "",
   "SELECT stream_id, seq, nth + max(dts - nth) OVER (PARTITION BY stream_id ORDER BY seq) AS dts FROM (SELECT user_id AS stream_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS dts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)")
def _(lib):
    monitors.use_state_store(lib.spark)
    feed = events(lib, "user_id AS stream_id", "event_id AS seq", "cast(floor(value) AS bigint) AS dts").drop("ts")
    return drained(lib, monitors.repair_dts_stream(feed), "r9")
