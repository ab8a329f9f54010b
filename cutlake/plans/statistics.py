"""Queries: statistics (a*), windows (w*), top-k (t*) and set operations (o*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.operators import joins, ranking, sets, stats, timejobs, windows
from cutlake.plans.joining import ACTIVE, POINTS, other_render, points, pool, pool_sql
from cutlake.plans.registry import REGISTRY, Lib

q = REGISTRY.add

STAGES = ["Decode", "Upload", "UploadSubmit", "Composite", "GpuTransfer"]


def r6(df, *cols, digits: int = 6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


def stages(lib: Lib):
    return lib.frame_stages.selectExpr("run_id", "frame_index", "stage", "clock", "us / 1000e0 AS ms")


_FS = "fs AS (SELECT run_id, frame_index, stage, clock, us / 1000e0 AS ms FROM frame_stages)"
_TOTALS = (
    "tot AS (SELECT run_id, frame_index, coalesce(sum(CASE WHEN clock = 'cpu' AND stage NOT IN ('UploadPrepare','UploadSubmit') THEN ms END), 0) AS total_ms "
    "FROM fs GROUP BY 1, 2)"
)


def rank_sql(p: float) -> str:
    return f"CAST(greatest(ceil(n * {p}e0), 1) AS BIGINT)"


_STAGE_SQL = (
    f"{_FS}, {_TOTALS}, pf AS (SELECT run_id, frame_index, stage, clock, sum(ms) AS ms FROM fs GROUP BY ALL), "
    "dn AS (SELECT f.run_id, s.stage, coalesce(p.ms, 0e0) AS ms, row_number() OVER (PARTITION BY f.run_id, s.stage ORDER BY coalesce(p.ms, 0e0)) AS rn, "
    "count(*) OVER (PARTITION BY f.run_id, s.stage) AS n FROM (SELECT DISTINCT run_id, frame_index FROM fs) f "
    f"CROSS JOIN (SELECT unnest({STAGES}) AS stage) s LEFT JOIN pf p ON p.run_id = f.run_id AND p.frame_index = f.frame_index AND p.stage = s.stage AND p.clock = 'cpu'), "
    "gp AS (SELECT run_id, stage, ms, row_number() OVER (PARTITION BY run_id, stage ORDER BY ms) AS rn, count(*) OVER (PARTITION BY run_id, stage) AS n FROM pf WHERE clock = 'gpu'), "
    f"ga AS (SELECT run_id, stage, avg(ms) AS a, max(CASE WHEN rn = {rank_sql(0.95)} THEN ms END) AS p95, max(CASE WHEN rn = {rank_sql(0.99)} THEN ms END) AS p99 FROM gp GROUP BY 1, 2), "
    f"st AS (SELECT run_id, stage, max(n) AS n, min(ms) AS lo, max(ms) AS hi, sum(ms) AS t, max(CASE WHEN rn = {rank_sql(0.95)} THEN ms END) AS p95, max(CASE WHEN rn = {rank_sql(0.99)} THEN ms END) AS p99 FROM dn GROUP BY 1, 2), "
    "rt AS (SELECT run_id, sum(total_ms) AS run_ms FROM tot GROUP BY 1)"
)


@q("a1_stage_stats", "frame_stages",
   'SELECT run_id, stage, n AS "count", round(lo, 6) AS min_ms, round(hi, 6) AS max_ms, round(t / n, 6) AS avg_ms, round(st.p95, 6) AS p95_ms, round(st.p99, 6) AS p99_ms, '
   "round(t, 6) AS total_ms, round(coalesce(t * 100 / nullif(run_ms, 0), 0), 6) AS share_pct, round(a, 6) AS gpu_avg_ms, round(ga.p95, 6) AS gpu_p95_ms, round(ga.p99, 6) AS gpu_p99_ms "
   "FROM st LEFT JOIN ga USING (run_id, stage) JOIN rt USING (run_id)", _STAGE_SQL)
def _(lib):
    out = stats.stage_stats(stages(lib), STAGES)
    return r6(out, *[c for c in out.columns if c not in ("run_id", "stage", "count")])


@q("a2_frame_totals", "frame_stages", "SELECT run_id, frame_index, round(total_ms, 6) AS total_ms FROM tot", f"{_FS}, {_TOTALS}")
def _(lib):
    return r6(stats.frame_totals(stages(lib)), "total_ms")


def runs(lib: Lib):
    return lib.raw("supplier").selectExpr(
        "s_suppkey AS run_id", "floor(abs(s_acctbal) / 10) / 4 AS wall_s", "30e0 AS target_fps"
    )


@q("a3_run_summary", "frame_stages frame_latency",
   "SELECT r.run_id, coalesce(frames, 0) AS frames, round(coalesce(CASE WHEN wall_s > 0 THEN coalesce(frames, 0) / wall_s END, 0), 6) AS average_fps, "
   "round(coalesce(CASE WHEN ca > 0 THEN 1000 / ca END, 0), 6) AS cpu_bound_fps, round(coalesce(CASE WHEN c99 > 0 THEN 1000 / c99 END, 0), 6) AS p99_fps, "
   "round(coalesce(CASE WHEN wall_s > 0 THEN coalesce(frames, 0) / 30e0 / wall_s END, 0), 6) AS realtime_factor, round(CASE WHEN la > 0 THEN 1000 / la END, 6) AS latency_fps, "
   "abs(CASE WHEN la > 0 THEN 1000 / la END - coalesce(CASE WHEN wall_s > 0 THEN coalesce(frames, 0) / wall_s END, 0)) > coalesce(CASE WHEN wall_s > 0 THEN coalesce(frames, 0) / wall_s END, 0) * 0.1e0 AS latency_disagrees "
   "FROM (SELECT s_suppkey AS run_id, floor(abs(s_acctbal) / 10) / 4 AS wall_s FROM supplier) r LEFT JOIN "
   f"(SELECT run_id, max(n) AS frames, avg(total_ms) AS ca, max(CASE WHEN rn = {rank_sql(0.99)} THEN total_ms END) AS c99 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total_ms) AS rn, "
   "count(*) OVER (PARTITION BY run_id) AS n FROM tot) GROUP BY 1) c USING (run_id) LEFT JOIN (SELECT run_id, avg(latency_ms) AS la FROM frame_latency GROUP BY 1) l USING (run_id)",
   f"{_FS}, {_TOTALS}")
def _(lib):
    out = stats.run_summary(runs(lib), stats.frame_totals(stages(lib)), lib.frame_latency)
    return r6(out, "average_fps", "cpu_bound_fps", "p99_fps", "realtime_factor", "latency_fps")


_STAMPED = "sp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_index) AS nth FROM frame_latency WHERE latency_ms IS NOT NULL)"


@q("a4_latency_split", "frame_latency",
   "SELECT f.run_id, f.latency_ms AS fill_ms, c AS steady_count, lo AS steady_min_ms, hi AS steady_max_ms, round(a, 6) AS steady_avg_ms, p95 AS steady_p95_ms, p99 AS steady_p99_ms "
   "FROM (SELECT run_id, latency_ms FROM sp WHERE nth = 1) f LEFT JOIN (SELECT run_id, max(n) AS c, min(latency_ms) AS lo, max(latency_ms) AS hi, avg(latency_ms) AS a, "
   f"max(CASE WHEN rn = {rank_sql(0.95)} THEN latency_ms END) AS p95, max(CASE WHEN rn = {rank_sql(0.99)} THEN latency_ms END) AS p99 FROM "
   "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM sp WHERE nth > 1) GROUP BY 1) s USING (run_id)", _STAMPED)
def _(lib):
    return r6(stats.latency_split(lib.frame_latency), "steady_avg_ms")


@q("a5_latency_alternation", "frame_latency",
   "SELECT run_id, stamped, round(e, 6) AS even_ms, round(o, 6) AS odd_ms, round(CASE WHEN least(e, o) > 0 THEN (greatest(e, o) - least(e, o)) / least(e, o) * 100 END, 6) AS gap_pct FROM "
   "(SELECT run_id, count(*) AS stamped, CASE WHEN count(*) >= 5 THEN avg(CASE WHEN nth > 1 AND nth % 2 = 0 THEN latency_ms END) END AS e, "
   "CASE WHEN count(*) >= 5 THEN avg(CASE WHEN nth > 1 AND nth % 2 = 1 THEN latency_ms END) END AS o FROM sp GROUP BY 1)", _STAMPED)
def _(lib):
    return r6(stats.latency_alternation(lib.frame_latency), "even_ms", "odd_ms", "gap_pct")


# Frames with two measures, both with a heavy tail, for the outlier queries.
_TWO = (
    "two AS (SELECT user_id // 16 AS run_id, event_id AS frame_index, CASE WHEN value > 98 THEN value * 4 ELSE value END AS late_ms, "
    "CASE WHEN event_type = 'error' AND value > 90 THEN 500e0 ELSE (event_id * 7 % 100) / 10e0 END AS slow_ms FROM events)"
)


def two_measures(lib: Lib):
    return lib.raw("events").selectExpr(
        "user_id div 16 AS run_id", "event_id AS frame_index",
        "CASE WHEN value > 98 THEN value * 4 ELSE value END AS late_ms",
        "CASE WHEN event_type = 'error' AND value > 90 THEN 500e0 ELSE (event_id * 7 % 100) / 10e0 END AS slow_ms",
    )


def _mad_sql(name: str, col: str) -> str:
    return (
        f"{name}_m AS (SELECT run_id, {col} AS med FROM (SELECT run_id, {col}, row_number() OVER (PARTITION BY run_id ORDER BY {col}) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM two) WHERE rn = n // 2 + 1), "
        f"{name} AS (SELECT run_id, CASE WHEN d > 0 THEN med + 4.4478e0 * d ELSE med * 2 END AS thr FROM (SELECT run_id, med, abs({col} - med) AS d, row_number() OVER (PARTITION BY run_id ORDER BY abs({col} - med)) AS rn, "
        f"count(*) OVER (PARTITION BY run_id) AS n FROM two JOIN {name}_m USING (run_id)) WHERE rn = n // 2 + 1)"
    )


_BOTH_MADS = f"{_TWO}, {_mad_sql('la', 'late_ms')}, {_mad_sql('sl', 'slow_ms')}"


@q("a6_mad_outliers", "",
   "SELECT run_id, frame_index, late_ms, round(thr, 6) AS threshold FROM two JOIN la USING (run_id) WHERE late_ms > thr", _BOTH_MADS)
def _(lib):
    out = stats.mad_outliers(two_measures(lib).select("run_id", "frame_index", "late_ms"), "late_ms", ["run_id"])
    return r6(out, "threshold")


@q("a7_pearson", "",
   "SELECT run_id, n, round(CASE WHEN n >= 3 AND vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END, 6) AS r FROM (SELECT run_id, count(*) AS n, covar_pop(late_ms, slow_ms) AS c, "
   "var_pop(late_ms) AS vx, var_pop(slow_ms) AS vy FROM two WHERE slow_ms <> 5e0 GROUP BY 1)", _TWO)
def _(lib):
    df = two_measures(lib).withColumn("slow_ms", F.expr("nullif(slow_ms, 5e0)"))
    return r6(stats.pearson(df, "late_ms", "slow_ms", ["run_id"]), "r")


@q("a8_outlier_overlap", "",
   "SELECT run_id, CAST(count(*) FILTER (late_ms > la.thr) AS BIGINT) AS n_a, CAST(count(*) FILTER (slow_ms > sl.thr) AS BIGINT) AS n_b, "
   "CAST(count(*) FILTER (late_ms > la.thr AND slow_ms > sl.thr) AS BIGINT) AS n_both FROM two JOIN la USING (run_id) JOIN sl USING (run_id) GROUP BY 1", _BOTH_MADS)
def _(lib):
    return stats.outlier_overlap(two_measures(lib), "late_ms", "slow_ms", ["run_id"])


_REPEATS = (
    "rep AS (SELECT c_nationkey AS job, c_custkey % 900 AS frames, floor(abs(c_acctbal)) / 100 AS seconds, (c_custkey % 60) * 1e0 AS input_seconds, c_custkey * 1000 AS bytes, "
    "CAST(floor(c_acctbal) AS BIGINT) AS peak_bytes FROM customer), "
    "rated AS (SELECT *, CASE WHEN seconds > 0 AND frames > 0 THEN frames / seconds END AS fps, CASE WHEN seconds > 0 AND input_seconds > 0 THEN input_seconds / seconds END AS rt, "
    "CASE WHEN input_seconds > 0 AND bytes > 0 THEN bytes * 8 / input_seconds END AS br FROM rep)"
)


@q("a9_repeat_summary", "",
   "SELECT job, count(*) AS runs, max(peak_bytes) AS peak_bytes, round(median(seconds), 6) AS median_seconds, round(median(rt), 6) AS median_realtime, round(median(br), 4) AS median_bitrate_bps, "
   "round(median(fps), 6) AS median_fps, round(CASE WHEN count(fps) >= 2 AND median(fps) > 0 THEN (max(fps) - min(fps)) / median(fps) * 100 END, 6) AS fps_spread_pct FROM rated GROUP BY job", _REPEATS)
def _(lib):
    rep = lib.raw("customer").selectExpr(
        "c_nationkey AS job", "c_custkey % 900 AS frames", "floor(abs(c_acctbal)) / 100 AS seconds",
        "(c_custkey % 60) * 1e0 AS input_seconds", "c_custkey * 1000 AS bytes", "cast(floor(c_acctbal) AS bigint) AS peak_bytes",
    )
    out = r6(stats.repeat_summary(rep, ["job"]), "median_seconds", "median_realtime", "median_fps", "fps_spread_pct")
    return r6(out, "median_bitrate_bps", digits=4)


_BRACKETS = (
    "br AS (SELECT l_suppkey AS run_id, l_orderkey // 300 AS frame, l_orderkey * 100000 + l_partkey AS seq, l_returnflag AS node, l_quantity + l_linenumber / 8e0 AS ms FROM lineitem), "
    "nb AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame, node ORDER BY seq) AS instance FROM br), "
    "pn AS (SELECT run_id, node, count(*) AS samples, median(ms) AS med FROM nb GROUP BY 1, 2), "
    "ft AS (SELECT run_id, node, median(t) AS frame_total FROM (SELECT run_id, node, frame, sum(ms) AS t FROM nb GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "ins AS (SELECT run_id, node, instance, median(ms) AS m FROM nb GROUP BY 1, 2, 3), "
    "isp AS (SELECT run_id, node, count(*) AS per_frame, CASE WHEN count(*) >= 2 AND median(m) > 0 THEN (max(m) - min(m)) / median(m) * 100 END AS spread FROM ins GROUP BY 1, 2), "
    "nt AS (SELECT run_id, node, samples, per_frame, round(med, 6) AS median_ms, round(frame_total, 6) AS frame_total_ms, round(spread, 6) AS instance_spread_pct, coalesce(spread > 10, false) AS uneven FROM pn JOIN ft USING (run_id, node) JOIN isp USING (run_id, node))"
)


def node_brackets(lib: Lib):
    return lib.raw("lineitem").selectExpr(
        "l_suppkey AS run_id", "l_orderkey div 300 AS frame", "l_orderkey * 100000 + l_partkey AS seq",
        "l_returnflag AS node", "l_quantity + l_linenumber / 8e0 AS ms",
    )


def node_report(brackets):
    return r6(stats.node_timings(brackets), "median_ms", "frame_total_ms", "instance_spread_pct")


@q("a10_node_timings", "", "SELECT * FROM nt", _BRACKETS)
def _(lib):
    return node_report(node_brackets(lib))


@q("t3_top_nodes", "", "SELECT * FROM nt ORDER BY frame_total_ms DESC, run_id, node LIMIT 20", _BRACKETS)
def _(lib):
    # The nodes are chosen by their frame totals; only theirs are reported on.
    brackets = node_brackets(lib)
    top = ranking.top_nodes(r6(stats.node_frame_totals(brackets), "frame_total_ms"), 20).select("run_id", "node")
    return ranking.top_nodes(node_report(brackets.join(top, ["run_id", "node"], "left_semi")), 20)


@q("a11_transfer_metrics", "frame_stages frame_latency",
   "SELECT g.run_id, round(CASE WHEN lat > 0 AND gpu > 0 THEN gpu / lat * 100 END, 6) AS gpu_consistency_pct, round(CASE WHEN tr > 0 THEN up / nullif(fr, 0) / (tr / 1000) / 1e9 END, 9) AS transfer_gbps "
   "FROM (SELECT run_id, sum(a) AS gpu, max(CASE WHEN stage = 'GpuTransfer' THEN a END) AS tr FROM ga WHERE stage IN ('Decode','Upload','UploadSubmit','Composite','GpuTransfer') GROUP BY 1) g "
   "LEFT JOIN (SELECT run_id, avg(latency_ms) AS lat FROM frame_latency GROUP BY 1) l USING (run_id) "
   "LEFT JOIN (SELECT l_suppkey AS run_id, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS up, count(DISTINCT l_orderkey) AS fr FROM lineitem GROUP BY 1) u USING (run_id)", _STAGE_SQL)
def _(lib):
    uploads = lib.raw("lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(
        F.sum(F.floor("l_extendedprice")).alias("upload_bytes"), F.countDistinct("l_orderkey").alias("frames")
    )
    out = stats.transfer_metrics(stats.stage_stats(stages(lib), STAGES), lib.frame_latency, uploads)
    return r6(r6(out, "gpu_consistency_pct"), "transfer_gbps", digits=9)


_SYNC = (
    "se AS (SELECT *, (video_pts - audio_pts) * 1000000000 // 90000 AS e, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS nth, count(*) OVER (PARTITION BY session_id) AS n FROM av_samples)"
)


@q("a12_sync_stats", "av_samples",
   "SELECT session_id, max(n) AS pairs, round(sqrt(avg(CAST(e AS DOUBLE) * e)), 2) AS rms_ns, max(abs(e)) AS max_ns, round(sqrt(avg(CASE WHEN nth * 2 <= n THEN CAST(e AS DOUBLE) * e END)), 2) AS first_half_rms_ns, "
   "round(sqrt(avg(CASE WHEN nth * 2 > n THEN CAST(e AS DOUBLE) * e END)), 2) AS second_half_rms_ns, arg_min(e, nth) AS start_ns, arg_max(e, nth) AS end_ns FROM se GROUP BY 1", _SYNC)
def _(lib):
    out = stats.sync_stats(lib.av_samples)
    return r6(out, "rms_ns", "first_half_rms_ns", "second_half_rms_ns", digits=2)


@q("a12_sync_histogram", "av_samples", "SELECT session_id, e // 1000000 AS bin_ms, count(*) AS pairs FROM se GROUP BY 1, 2", _SYNC)
def _(lib):
    return stats.sync_histogram(lib.av_samples)


@q("a13_project_duration", "clips jobs",
   "SELECT j.project_id, coalesce(m, 0) AS end_pts, coalesce(m * 30000 // (1001 * 90000), 0) AS frames FROM (SELECT DISTINCT project_id + 3 AS project_id FROM jobs) j "
   "LEFT JOIN (SELECT project_id, max(pts_out) AS m FROM clips GROUP BY 1) USING (project_id)")
def _(lib):
    projects = lib.jobs.selectExpr("project_id + 3 AS project_id", "30000L AS fps_num", "1001L AS fps_den").distinct()
    return stats.project_duration(lib.clips, projects)


@q("a14_peak_overlap", "clips",
   "SELECT project_id, track_id, held, CAST(ideal AS BIGINT) AS ideal FROM (SELECT project_id, track_id, max(live) AS ideal FROM (SELECT project_id, track_id, sum(sum(d)) OVER (PARTITION BY project_id, track_id ORDER BY t) AS live "
   "FROM (SELECT project_id, track_id, pts_in AS t, 1 AS d FROM clips UNION ALL SELECT project_id, track_id, pts_out + 1, -1 FROM clips) GROUP BY project_id, track_id, t) GROUP BY 1, 2) "
   "JOIN (SELECT project_id, track_id, count(*) AS held FROM clips GROUP BY 1, 2) USING (project_id, track_id)")
def _(lib):
    return stats.peak_overlap(lib.clips, ["project_id", "track_id"], "pts_in", "pts_out")


@q("a15_waveform_peaks", "samples",
   'SELECT source_id, sample_idx // 10 AS peak_idx, round(max(abs(("left" + "right") / 2)), 7) AS peak FROM samples GROUP BY 1, 2')
def _(lib):
    return r6(stats.waveform_peaks(lib.samples, 10), "peak", digits=7)


@q("a16_additive_linearity", "",
   "SELECT c.g AS group_id, max(c.obs) AS observed_ms, CASE WHEN count(s.m) = count(*) THEN sum(s.m) END AS additive_ms, round(max(c.obs) / CASE WHEN count(s.m) = count(*) THEN sum(s.m) END, 6) AS linearity FROM "
   "(SELECT s_nationkey AS g, CASE WHEN s_acctbal < -500 THEN -1 - s_suppkey ELSE s_suppkey END AS member, 50e0 + s_nationkey AS obs FROM supplier) c LEFT JOIN "
   "(SELECT member, m FROM (SELECT l_suppkey AS member, l_quantity AS m, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE rn = n // 2 + 1) s USING (member) GROUP BY 1")
def _(lib):
    solo = lib.raw("lineitem").selectExpr("l_suppkey AS member", "l_quantity AS ms")
    together = lib.raw("supplier").selectExpr(
        "s_nationkey AS group_id", "CASE WHEN s_acctbal < -500 THEN -1 - s_suppkey ELSE s_suppkey END AS member",
        "50e0 + s_nationkey AS observed_ms",
    )
    return r6(stats.additive_linearity(solo, together), "linearity")


@q("a17_decode_manifest", "clips",
   "SELECT source_id, source_pts // 3000 * 3000 AS quantised_pts, min(pts) AS frame_index FROM active GROUP BY 1, 2", f"{POINTS}, {ACTIVE}")
def _(lib):
    active = joins.active_at(points(lib), lib.clips)
    frames = active.selectExpr("source_id", "source_pts div 3000 * 3000 AS quantised_pts", "pts AS frame_index")
    return stats.decode_manifest(frames)


@q("a18_storage_estimate", "sources",
   "SELECT project_id, pixel_fmt, count(*) AS sources, CAST(sum((b + 255) // 256 * 256) AS BIGINT) AS frame_bytes FROM (SELECT project_id, pixel_fmt, CASE WHEN pixel_fmt IN ('Yuv420p','Nv12') THEN pl "
   "WHEN pixel_fmt IN ('P010','Yuv420p10','Yuv420p12') THEN pl * 2 WHEN pixel_fmt = 'Yuv422p' THEN px * 2 WHEN pixel_fmt = 'Yuv444p' THEN px * 3 WHEN pixel_fmt IN ('Yuv422p10','Rgba8') THEN px * 4 "
   "WHEN pixel_fmt IN ('Yuv444p10','Yuv444p12') THEN px * 6 ELSE px * 8 END AS b FROM (SELECT source_id // 100 AS project_id, pixel_fmt, CAST(width AS BIGINT) * height AS px, "
   "CAST(width AS BIGINT) * height + ((width + 1) // 2) * ((height + 1) // 2) * 2 AS pl FROM sources)) GROUP BY ROLLUP (project_id, pixel_fmt)")
def _(lib):
    return stats.storage_estimate(lib.sources.withColumn("project_id", F.expr("source_id div 100")))


@q("a19_miss_rate", "",
   "SELECT bucket, kind, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS misses, round(sum(m) / nullif(sum(h) + sum(m), 0), 6) AS miss_rate FROM (SELECT user_id AS bucket, event_type AS kind, "
   "CASE WHEN event_type <> 'error' AND value >= 20 THEN 1 ELSE 0 END AS h, CASE WHEN event_type <> 'error' AND value < 20 THEN 1 ELSE 0 END AS m FROM events) GROUP BY 1, 2")
def _(lib):
    counters = lib.raw("events").selectExpr(
        "user_id AS bucket", "event_type AS kind", "CASE WHEN event_type <> 'error' AND value >= 20 THEN 1 ELSE 0 END AS hits",
        "CASE WHEN event_type <> 'error' AND value < 20 THEN 1 ELSE 0 END AS misses",
    )
    return r6(stats.miss_rate(counters, ["bucket", "kind"]), "miss_rate")


@q("a20_light_levels", "pixels",
   "SELECT render_id, round(max(pk), 4) AS max_cll, round(max(av), 4) AS max_fall FROM (SELECT frame_id // 25 AS render_id, frame_id, max(greatest(r, g, b) * 1000) AS pk, avg(greatest(r, g, b) * 1000) AS av FROM pixels GROUP BY 1, 2) GROUP BY 1")
def _(lib):
    px = lib.pixels.selectExpr("frame_id div 25 AS render_id", "frame_id", "greatest(r, g, b) * 1000 AS nits")
    return r6(stats.light_levels(px, ["render_id"]), "max_cll", "max_fall", digits=4)


@q("w1_track_slots", "clips",
   "SELECT project_id, track_id, clip_id, row_number() OVER (PARTITION BY project_id, track_id ORDER BY pts_in, clip_id) - 1 AS slot FROM clips")
def _(lib):
    return windows.track_slots(lib.clips).select("project_id", "track_id", "clip_id", "slot")


@q("w3_frame_intervals", "",
   "SELECT user_id AS run_id, event_id AS frame_index, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000, 3) AS latency_ms FROM events")
def _(lib):
    frames = lib.raw("events").selectExpr(
        "user_id AS run_id", "event_id AS frame_index", "unix_micros(cast(ts AS timestamp)) AS retired_us"
    )
    return r6(windows.frame_intervals(frames).select("run_id", "frame_index", "latency_ms"), "latency_ms", digits=3)


@q("w4_track_gaps", "clips",
   "SELECT project_id, track_id, reach AS gap_in, pts_in AS gap_out FROM (SELECT project_id, track_id, pts_in, max(max(pts_out)) OVER (PARTITION BY project_id, track_id ORDER BY pts_in ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach "
   "FROM clips GROUP BY 1, 2, 3) WHERE pts_in > reach")
def _(lib):
    return windows.track_gaps(lib.clips)


_PK = "pk AS (SELECT source_id AS stream_id, seq, min(pts) AS dts FROM packets GROUP BY 1, 2)"


def stream_packets(lib: Lib):
    return lib.packets.groupBy(F.col("source_id").alias("stream_id"), "seq").agg(F.min("pts").alias("dts"))


@q("w5_check_dts", "packets",
   "SELECT * FROM (SELECT *, lag(dts) OVER (PARTITION BY stream_id ORDER BY seq) AS prev_dts FROM pk) WHERE dts <= prev_dts", _PK)
def _(lib):
    return windows.check_dts(stream_packets(lib))


@q("w5_repair_dts", "packets",
   "SELECT stream_id, seq, nth + max(dts - nth) OVER (PARTITION BY stream_id ORDER BY seq) AS dts FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS nth FROM pk)", _PK)
def _(lib):
    return windows.repair_dts(stream_packets(lib))


_VALID = "vj AS (SELECT * FROM jobs WHERE pts_in < pts_out AND fps_num > 0)"
_GRID = (
    f"{_VALID}, nj AS (SELECT *, ((pts_out - pts_in) * fps_num + 90000 * fps_den - 1) // (90000 * fps_den) AS n FROM vj), "
    "grid AS (SELECT job_id, frame, pts_in + (frame * fps_den * 90000 + fps_num // 2) // fps_num AS pts FROM (SELECT *, unnest(range(n)) AS frame FROM nj))"
)


def valid_jobs(lib: Lib):
    return lib.jobs.where("pts_in < pts_out AND fps_num > 0")


@q("w6_grid_uniform", "jobs",
   "SELECT g.job_id, count(*) AS frames, coalesce(max(abs(step - nominal)) <= 1, true) AS even, min(pts) = any_value(j.pts_in) AS starts, "
   "any_value(j.pts_out) - max(pts) BETWEEN 0 AND any_value(nominal) + 1 AS spans FROM (SELECT *, lead(pts) OVER (PARTITION BY job_id ORDER BY frame) - pts AS step FROM grid) g "
   "JOIN (SELECT *, (fps_den * 90000 + fps_num // 2) // fps_num AS nominal FROM vj) j USING (job_id) GROUP BY 1", _GRID)
def _(lib):
    jobs = valid_jobs(lib)
    return windows.grid_uniform(timejobs.frame_grid(jobs).select("job_id", "frame", "pts"), jobs)


@q("w7_detect_vfr", "sources",
   "SELECT source_id, fps_num <> 0 AND a <> 0 AND CAST(fps_num AS BIGINT) * 1001 <> CAST(a AS BIGINT) * fps_den AS is_vfr FROM (SELECT *, CASE p % 4 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 24000 ELSE 25025 END AS a FROM (SELECT *, source_id AS p FROM sources))")
def _(lib):
    streams = lib.sources.selectExpr(
        "source_id", "fps_num AS r_num", "fps_den AS r_den",
        "CASE source_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 24000 ELSE 25025 END AS avg_num", "1001 AS avg_den",
    )
    return windows.detect_vfr(streams).select("source_id", "is_vfr")


@q("w7_packet_steps", "packets",
   "SELECT source_id, min(g) AS min_step, max(g) AS max_step, coalesce(min(g) <> max(g), false) AS is_vfr FROM (SELECT source_id, pts - lag(pts) OVER (PARTITION BY source_id ORDER BY pts) AS g FROM (SELECT DISTINCT source_id, pts FROM packets)) GROUP BY 1")
def _(lib):
    return windows.packet_steps(lib.packets)


@q("w8_gaussian_lines", "pixels",
   "SELECT p.frame_id, p.x, p.y, round(sum(n.r * w) / sum(w), 6) AS r, round(sum(n.g * w) / sum(w), 6) AS g, round(sum(n.b * w) / sum(w), 6) AS b, round(sum(n.a * w) / sum(w), 6) AS a FROM pixels p, "
   "(SELECT i, exp(-(i * i) / (2 * 1.5e0 * 1.5e0)) AS w FROM (SELECT unnest(range(-3, 4)) AS i)) k, pixels n WHERE n.frame_id = p.frame_id AND n.y = p.y AND n.x = least(greatest(p.x + k.i, 0), 6) GROUP BY 1, 2, 3")
def _(lib):
    return r6(windows.gaussian_lines(lib.pixels, 3.0, 1.5, "x"), "r", "g", "b", "a")


@q("t2_worst_frames", "frame_latency",
   "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY latency_ms DESC, frame_index) AS INTEGER) AS place FROM frame_latency WHERE latency_ms IS NOT NULL) WHERE place <= 5")
def _(lib):
    return ranking.worst_frames(lib.frame_latency, 5)


_MOVES = (
    "tr AS (SELECT DISTINCT project_id, track_id, track_id AS position FROM clips), "
    "mv AS (SELECT DISTINCT project_id, CAST(project_id % 6 AS INTEGER) AS track_id, CAST(project_id * 3 % 7 AS INTEGER) AS new_index FROM clips), "
    "ck AS (SELECT m.*, t.position AS f, l.n FROM mv m LEFT JOIN tr t USING (project_id, track_id) LEFT JOIN (SELECT project_id, count(*) AS n FROM tr GROUP BY 1) l USING (project_id)), "
    "gd AS (SELECT project_id, f, least(new_index, n - 1) AS t FROM ck WHERE f IS NOT NULL AND new_index <= n)"
)


def _track_moves(lib: Lib):
    tr = lib.clips.selectExpr("project_id", "track_id", "track_id AS position").distinct()
    mv = lib.clips.selectExpr(
        "project_id", "cast(project_id % 6 AS int) AS track_id", "cast(project_id * 3 % 7 AS int) AS new_index"
    ).distinct()
    return ranking.reorder_tracks(tr, mv)


@q("t4_reorder_tracks", "clips",
   "SELECT project_id, track_id, CAST(CASE WHEN f IS NULL THEN position WHEN position = f THEN t WHEN position > f AND position <= t THEN position - 1 "
   "WHEN position < f AND position >= t THEN position + 1 ELSE position END AS INTEGER) AS position FROM tr LEFT JOIN gd USING (project_id)", _MOVES)
def _(lib):
    return _track_moves(lib)[0]


@q("t4_reorder_rejects", "clips",
   "SELECT project_id, track_id, new_index, CASE WHEN f IS NULL THEN 'TrackNotFound' ELSE 'TrackLimitReached' END AS reason FROM ck WHERE f IS NULL OR new_index > n", _MOVES)
def _(lib):
    return _track_moves(lib)[1]


@q("o1_outlier_intersection", "",
   "SELECT run_id, frame_index FROM two JOIN la USING (run_id) WHERE late_ms > thr INTERSECT SELECT run_id, frame_index FROM two JOIN sl USING (run_id) WHERE slow_ms > thr", _BOTH_MADS)
def _(lib):
    df = two_measures(lib)
    late = stats.mad_outliers(df, "late_ms", ["run_id"]).select("run_id", "frame_index")
    slow = stats.mad_outliers(df, "slow_ms", ["run_id"]).select("run_id", "frame_index")
    return sets.outlier_intersection(late, slow)


@q("o2_interval_union", "clips",
   "SELECT project_id, min(pts_in) AS pts_in, max(pts_out) AS pts_out FROM (SELECT *, sum(n) OVER (PARTITION BY project_id ORDER BY pts_in, clip_id) AS island FROM "
   "(SELECT *, CASE WHEN pts_in <= max(pts_out) OVER (PARTITION BY project_id ORDER BY pts_in, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM clips)) GROUP BY project_id, island")
def _(lib):
    return sets.interval_union(lib.clips.select("project_id", "pts_in", "pts_out"), ["project_id"])


@q("o2_interval_subtract", "clips",
   "SELECT clip_id, pi AS piece_in, po AS piece_out FROM (SELECT clip_id, greatest(pts_in, coalesce(m, pts_in)) AS pi, least(pts_out, lo) AS po FROM "
   "(SELECT *, max(hi) OVER (PARTITION BY clip_id ORDER BY lo, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h) UNION ALL "
   "SELECT clip_id, greatest(any_value(pts_in), max(hi)), any_value(pts_out) FROM h GROUP BY clip_id UNION ALL "
   "SELECT clip_id, pts_in, pts_out FROM clips WHERE kind = 'Video' AND clip_id NOT IN (SELECT clip_id FROM h)) WHERE pi < po",
   "h AS (SELECT a.clip_id, a.pts_in, a.pts_out, b.clip_id AS cid, b.pts_in AS lo, b.pts_out AS hi FROM clips a JOIN clips b ON a.project_id = b.project_id AND a.kind = 'Video' AND b.kind <> 'Video' AND a.pts_in < b.pts_out AND b.pts_in < a.pts_out)")
def _(lib):
    clips = lib.clips.select("project_id", "clip_id", "kind", "pts_in", "pts_out")
    out = sets.interval_subtract(
        clips.where("kind = 'Video'"), clips.where("kind <> 'Video'"), ["project_id"], ["project_id", "clip_id"]
    )
    return out.select("clip_id", "piece_in", "piece_out")


@q("o3_missing_frames", "pixels",
   "SELECT frame_id, x, y FROM pixels EXCEPT SELECT frame_id, x, y FROM pixels WHERE NOT (a < 0.7e0 AND x = 3)")
def _(lib):
    at = ["frame_id", "x", "y"]
    return sets.missing_frames(lib.pixels.select(*at), other_render(lib), at)


@q("o4_unknown_sources", "strip",
   "SELECT DISTINCT project_id, source_id FROM strip ANTI JOIN pool USING (project_id, source_id)", pool_sql("strip"))
def _(lib):
    return sets.unknown_sources(lib.strip, pool(lib.strip))


@q("o5_diff_projects", "strip",
   "SELECT project_id, clip_id, CASE WHEN o.opacity IS NULL THEN 'added' WHEN n.opacity IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT project_id, clip_id, opacity, kind FROM strip) o "
   "FULL JOIN (SELECT project_id, CASE WHEN fade_in_pts = 27000 THEN clip_id + 1000000000 ELSE clip_id END AS clip_id, CASE WHEN kind = 'Audio' THEN opacity / 2 ELSE opacity END AS opacity, kind FROM strip WHERE NOT audio_muted) n "
   "USING (project_id, clip_id) WHERE o.opacity IS DISTINCT FROM n.opacity")
def _(lib):
    old = lib.strip.select("project_id", "clip_id", "opacity", "kind")
    new = lib.strip.where("NOT audio_muted").selectExpr(
        "project_id", "CASE WHEN fade_in_pts = 27000 THEN clip_id + 1000000000 ELSE clip_id END AS clip_id",
        "CASE WHEN kind = 'Audio' THEN opacity / 2 ELSE opacity END AS opacity", "kind",
    )
    return sets.diff_projects(old, new, ["project_id", "clip_id"]).select("project_id", "clip_id", "change")
