"""Queries: exact time jobs (d*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.operators import joins, timejobs
from cutlake.plans.joining import ACTIVE, POINTS, half_away, points
from cutlake.plans.registry import REGISTRY, Lib
from cutlake.plans.statistics import valid_jobs

q = REGISTRY.add

_RATE_NUM = (
    "cast(case n_nationkey % 10 when 0 then 24000 when 1 then 24 when 2 then 25 when 3 then 30000 when 4 then 30 "
    "when 5 then 50 when 6 then 60000 when 7 then 60 when 8 then 120 else 0 end as bigint)"
)
_RATE_DEN = "cast(case when n_nationkey % 10 in (0, 3, 6) then 1001 else 1 end as bigint)"
_TB_NUM = "cast(case when n_nationkey % 7 = 6 then 0 else 1 + n_nationkey % 3 end as bigint)"
_TB_DEN = (
    "cast(case n_nationkey % 5 when 0 then 90000 when 1 then 48000 when 2 then 44100 when 3 then 1000000 else 30000 end as bigint)"
)
RATES = f"rates AS (SELECT CAST(n_nationkey AS BIGINT) AS rate_id, {_RATE_NUM} AS num, {_RATE_DEN} AS den FROM nation)"
_TBS = f"tbs AS (SELECT CAST(n_nationkey AS BIGINT) AS tb_id, {_TB_NUM} AS num, {_TB_DEN} AS den FROM nation)"


def rates(lib: Lib):
    return lib.raw("nation").selectExpr("cast(n_nationkey AS bigint) AS rate_id", f"{_RATE_NUM} AS num", f"{_RATE_DEN} AS den")


def timebases(lib: Lib):
    return lib.raw("nation").selectExpr("cast(n_nationkey AS bigint) AS tb_id", f"{_TB_NUM} AS num", f"{_TB_DEN} AS den")


_STAMPS = (
    "stm AS (SELECT o_orderkey AS id, o_custkey % 30 AS rate_id, o_custkey % 30 AS tb_id, o_orderkey * 300301 - 700000000 AS pts, o_orderkey * 17 - 9000 AS frame, "
    "o_orderkey * 1234567 - 5000000000 AS ns, (o_orderkey - 7000) * 901 AS \"offset\", CASE o_custkey % 6 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.3333e0 WHEN 2 THEN 2e0 WHEN 3 THEN 0e0 WHEN 4 THEN -1e0 ELSE 0.00025e0 END AS speed FROM orders)"
)


def stamps(lib: Lib):
    return lib.raw("orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 30 AS rate_id", "o_custkey % 30 AS tb_id", "o_orderkey * 300301 - 700000000 AS pts",
        "o_orderkey * 17 - 9000 AS frame", "o_orderkey * 1234567 - 5000000000 AS ns", "(o_orderkey - 7000) * 901 AS offset",
        "CASE o_custkey % 6 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.3333e0 WHEN 2 THEN 2e0 WHEN 3 THEN 0e0 WHEN 4 THEN -1e0 ELSE 0.00025e0 END AS speed",
    )


@q("d1_rescale", "",
   "SELECT id, CAST(CAST(pts AS HUGEINT) * num * 48000 // (den * 1) AS BIGINT) AS rescaled FROM stm JOIN tbs USING (tb_id) WHERE num <> 0 AND den <> 0", f"{_STAMPS}, {_TBS}")
def _(lib):
    return timejobs.rescale(stamps(lib), timebases(lib), "tb_id", (1, 48000))[0].select("id", "rescaled")


@q("d1_rescale_rejects", "",
   "SELECT id, 'InvalidRate' AS error FROM stm LEFT JOIN tbs USING (tb_id) WHERE num IS NULL OR num = 0 OR den = 0", f"{_STAMPS}, {_TBS}")
def _(lib):
    return timejobs.rescale(stamps(lib), timebases(lib), "tb_id", (1, 48000))[1].select("id", "error")


@q("d2_ticks_and_ns", "",
   "SELECT id, CAST(CAST(pts AS HUGEINT) * 1000000000 // 90000 AS BIGINT) AS ns, CAST(CAST(ns AS HUGEINT) * 90000 // 1000000000 AS BIGINT) AS back_pts FROM stm", _STAMPS)
def _(lib):
    s = stamps(lib)
    ns = timejobs.to_ns(s.select("id", "pts"))
    back = timejobs.from_ns(s.select("id", "ns")).select("id", F.col("pts").alias("back_pts"))
    return ns.join(back, "id").select("id", "ns", "back_pts")


@q("d3_frame_to_pts", "",
   "SELECT id, " + half_away("(frame * den * 90000)", "num") + " AS pts_rounded, frame * den * 90000 // num AS pts_truncated FROM stm JOIN rates USING (rate_id) WHERE num <> 0", f"{_STAMPS}, {RATES}")
def _(lib):
    s = stamps(lib).select("id", "rate_id", "frame")
    a = timejobs.frame_to_pts(s, rates(lib), "rate_id")[0].select("id", F.col("pts").alias("pts_rounded"))
    b = timejobs.frame_to_pts(s, rates(lib), "rate_id", "truncate")[0].select("id", F.col("pts").alias("pts_truncated"))
    return a.join(b, "id")


@q("d3_pts_to_frame", "",
   "SELECT id, " + half_away("(pts * num)", "(90000 * den)") + " AS frame_rounded, pts * num // (90000 * den) AS frame_truncated FROM stm JOIN rates USING (rate_id) WHERE num <> 0", f"{_STAMPS}, {RATES}")
def _(lib):
    s = stamps(lib).select("id", "rate_id", "pts")
    a = timejobs.pts_to_frame(s, rates(lib), "rate_id")[0].select("id", F.col("frame").alias("frame_rounded"))
    b = timejobs.pts_to_frame(s, rates(lib), "rate_id", "truncate")[0].select("id", F.col("frame").alias("frame_truncated"))
    return a.join(b, "id")


_U = "CAST(round(speed * 10000) AS BIGINT)"


@q("d4_source_offset", "",
   "SELECT id, " + half_away('("offset" * u)', "10000") + ' AS source_offset, CASE WHEN u = 0 THEN "offset" ELSE ' + half_away('("offset" * 10000)', "u")
   + f" END AS timeline_offset FROM (SELECT *, {_U} AS u FROM stm)", _STAMPS)
def _(lib):
    return timejobs.source_offset(stamps(lib)).select("id", "source_offset", "timeline_offset")


_FRACTIONS = "fr AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey * 12 AS num, (l_suppkey - 50) * 8 AS den FROM lineitem)"


@q("d5_normalise_rates", "",
   "SELECT id, line, num, den, num // (gcd(num, den) * sign(den)) AS n, den // (gcd(num, den) * sign(den)) AS d FROM fr WHERE den <> 0", _FRACTIONS)
def _(lib):
    fr = lib.raw("lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "l_partkey * 12 AS num", "(l_suppkey - 50) * 8 AS den")
    return timejobs.normalise_rates(fr)[0].select("id", "line", "num", "den", "n", "d")


@q("d5_normalise_rates_rejects", "",
   "SELECT id, line, num, den, CASE WHEN den IS NULL THEN 'MissingPart' ELSE 'ZeroDenominator' END AS error FROM "
   "(SELECT id, line, num, CASE WHEN line < 5 THEN den END AS den FROM fr) WHERE den IS NULL OR den = 0", _FRACTIONS)
def _(lib):
    fr = lib.raw("lineitem").selectExpr(
        "l_orderkey AS id", "l_linenumber AS line", "l_partkey * 12 AS num", "CASE WHEN l_linenumber < 5 THEN (l_suppkey - 50) * 8 END AS den"
    )
    return timejobs.normalise_rates(fr)[1].select("id", "line", "num", "den", "error")


@q("d5_combine_rates", "",
   "SELECT id, sn // gcd(sn, sd) AS sum_num, sd // gcd(sn, sd) AS sum_den, pn // gcd(pn, sd) AS product_num, sd // gcd(pn, sd) AS product_den FROM "
   "(SELECT o_orderkey AS id, (o_custkey + 1) * 1001 + 30000 * (o_orderkey % 40 + 1) AS sn, (o_orderkey % 40 + 1) * 1001 AS sd, (o_custkey + 1) * 30000 AS pn FROM orders)")
def _(lib):
    pairs = lib.raw("orders").selectExpr(
        "o_orderkey AS id", "o_custkey + 1 AS a_num", "o_orderkey % 40 + 1 AS a_den", "30000L AS b_num", "1001L AS b_den"
    )
    return timejobs.combine_rates(pairs).select("id", "sum_num", "sum_den", "product_num", "product_den")


_TCS = (
    "tcs AS (SELECT o_orderkey AS id, o_custkey % 30 AS rate_id, concat(CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE '' END, lpad(cast(o_orderkey % 24 AS {s}), 2, '0'), ':', lpad(cast(o_custkey % 63 AS {s}), 2, '0'), "
    "':', lpad(cast(o_orderkey % 61 AS {s}), 2, '0'), CASE o_custkey % 3 WHEN 0 THEN ';' WHEN 1 THEN ':' ELSE CASE WHEN o_custkey % 7 = 0 THEN '.' ELSE ':' END END, "
    "CASE WHEN o_orderkey % 23 = 0 THEN 'x1' WHEN o_orderkey % 29 = 0 THEN '+5' WHEN o_orderkey % 31 = 0 THEN '123' ELSE lpad(cast(o_orderkey % 30 AS {s}), 2, '0') END) AS tc FROM orders)"
)
_TC_PARSE = (
    _TCS.format(s="VARCHAR") + f", {RATES}, rd AS (SELECT *, trim(tc) AS t, round(num / den) AS nom FROM tcs LEFT JOIN rates USING (rate_id)), "
    "er AS (SELECT *, CASE WHEN num IS NULL OR num = 0 THEN 'InvalidRate' WHEN length(t) <> 11 OR NOT regexp_full_match(t, '..:..:..[:;]..') THEN 'InvalidFormat' "
    "WHEN NOT regexp_full_match(t, '[0-9]{2}:[0-9]{2}:[0-9]{2}[:;]([0-9]{2}|\\+[0-9])') OR substr(t, 4, 2) >= '60' OR substr(t, 7, 2) >= '60' THEN 'InvalidComponents' END AS error FROM rd), "
    "pr AS (SELECT *, CAST(substr(t, 1, 2) AS BIGINT) AS h, CAST(substr(t, 4, 2) AS BIGINT) AS m, CAST(substr(t, 7, 2) AS BIGINT) AS s, CAST(replace(substr(t, 10, 2), '+', '') AS BIGINT) AS f, CAST(nom AS BIGINT) AS nm FROM er WHERE error IS NULL), "
    "fn AS (SELECT id, tc, rate_id, num, den, (h * 3600 + m * 60 + s) * nm + f - CASE WHEN substr(t, 9, 1) = ';' AND nm = 30 THEN (h * 60 + m - (h * 60 + m) // 10) * 2 ELSE 0 END AS frame FROM pr)"
)


def timecodes(lib: Lib):
    return lib.raw("orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 30 AS rate_id", _TCS.format(s="string").split("rate_id, ", 1)[1].rsplit(" FROM orders", 1)[0]
    )


@q("d6_parse_timecode", "", "SELECT id, tc, frame, frame * den * 90000 // num AS pts FROM fn", _TC_PARSE)
def _(lib):
    return timejobs.parse_timecode(timecodes(lib), rates(lib), "rate_id")[0].select("id", "tc", "frame", "pts")


@q("d6_parse_timecode_rejects", "", "SELECT id, tc, error FROM er WHERE error IS NOT NULL", _TC_PARSE)
def _(lib):
    return timejobs.parse_timecode(timecodes(lib), rates(lib), "rate_id")[1].select("id", "tc", "error")


@q("d7_format_timecode", "",
   "SELECT id, format('{:02d}:{:02d}:{:02d}{}{:02d}', g // nm // 3600, g // nm // 60 % 60, g // nm % 60, CASE WHEN dr THEN ';' ELSE ':' END, g % nm) AS tc FROM "
   "(SELECT *, CASE WHEN dr AND nm = 30 THEN f + 18 * (f // 17982) + CASE WHEN f % 17982 > 2 THEN 2 * ((f % 17982 - 2) // 1798) ELSE 0 END ELSE f END AS g FROM "
   "(SELECT id, greatest(pts * num // (90000 * den), 0) AS f, CAST(round(num / den) AS BIGINT) AS nm, den = 1001 AND num IN (30000, 60000) AS dr FROM stm JOIN rates USING (rate_id) WHERE num <> 0))",
   f"{_STAMPS}, {RATES}")
def _(lib):
    return timejobs.format_timecode(stamps(lib), rates(lib), "rate_id")[0].select("id", "tc")


_NJ = (
    "nj AS (SELECT *, ((pts_out - pts_in) * fps_num + 90000 * fps_den - 1) // (90000 * fps_den) AS n FROM jobs WHERE pts_in < pts_out AND fps_num > 0)"
)
_AT = "(pts_in + ({f} * fps_den * 90000 + fps_num // 2) // fps_num)"


@q("d8_frame_grid", "jobs",
   f"SELECT job_id, frame, {_AT.format(f='frame')} AS pts FROM (SELECT *, unnest(range(n)) AS frame FROM nj)", _NJ)
def _(lib):
    return timejobs.frame_grid(valid_jobs(lib)).select("job_id", "frame", "pts")


@q("d9_job_rejects", "jobs",
   "SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'MissingField' WHEN fps_num <= 0 OR fps_den <= 0 THEN 'InvalidRate' WHEN pts_in >= pts_out THEN 'InvalidDuration' ELSE 'NoThreads' END AS reason "
   "FROM jobs WHERE job_id % 5 = 0 OR fps_num <= 0 OR fps_den <= 0 OR pts_in >= pts_out OR threads <= 0")
def _(lib):
    jobs = lib.jobs.withColumn("pts_out", F.expr("CASE WHEN job_id % 5 > 0 THEN pts_out END"))
    return timejobs.job_rejects(jobs, threads=True).select("job_id", "reason")


@q("d9_partition_segments", "jobs",
   f"SELECT job_id, segment, fs AS frame_start, fe AS frame_end, {_AT.format(f='fs')} AS pts_start, CASE WHEN fe < n THEN {_AT.format(f='fe')} ELSE pts_out END AS pts_end FROM "
   "(SELECT *, segment * per AS fs, least((segment + 1) * per, n) AS fe FROM (SELECT *, unnest(range(least(threads, n))) AS segment FROM "
   "(SELECT *, (n + least(threads, n) - 1) // least(threads, n) AS per FROM nj WHERE threads > 0)) WHERE segment * per < n)", _NJ)
def _(lib):
    return timejobs.partition_segments(valid_jobs(lib)).select(
        "job_id", "segment", "frame_start", "frame_end", "pts_start", "pts_end"
    )


@q("d10_quantise_pts", "clips",
   "SELECT project_id, pts, clip_id, CASE WHEN still OR num = 0 THEN 0 WHEN vfr THEN (CASE WHEN tbd * den // num > 0 THEN source_pts * tbd // 90000 // (tbd * den // num) * (tbd * den // num) ELSE source_pts * tbd // 90000 END) * 90000 // tbd "
   "ELSE source_pts // (90000 * den // num) * (90000 * den // num) END AS quantised_pts FROM "
   "(SELECT *, kind = 'Image' AS still, source_id % 4 = 1 AS vfr, CASE source_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 25 WHEN 3 THEN 24000 ELSE 60 END AS num, "
   "CASE WHEN source_id % 5 IN (1, 3) THEN 1001 ELSE 1 END AS den, CASE source_id % 3 WHEN 0 THEN 12800 WHEN 1 THEN 15360 ELSE 1000 END AS tbd FROM active)", f"{POINTS}, {ACTIVE}")
def _(lib):
    active = joins.active_at(points(lib), lib.clips).selectExpr(
        "project_id", "pts", "clip_id", "source_pts", "kind = 'Image' AS is_still", "source_id % 4 = 1 AS is_vfr",
        "CASE source_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 30000 WHEN 2 THEN 25 WHEN 3 THEN 24000 ELSE 60 END AS fps_num",
        "CASE WHEN source_id % 5 IN (1, 3) THEN 1001 ELSE 1 END AS fps_den", "1L AS tb_num",
        "CASE source_id % 3 WHEN 0 THEN 12800 WHEN 1 THEN 15360 ELSE 1000 END AS tb_den",
    )
    return timejobs.quantise_pts(active).select("project_id", "pts", "clip_id", "quantised_pts")


@q("d11_clock_pts", "",
   "SELECT session_id, seq, CAST(total AS BIGINT) AS total_samples, CAST(500 + total * 90000 // 44100 AS BIGINT) AS clock_pts FROM (SELECT user_id AS session_id, event_id AS seq, sum(441 + event_id % 70) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)")
def _(lib):
    cb = lib.raw("events").selectExpr(
        "user_id AS session_id", "event_id AS seq", "441 + event_id % 70 AS samples", "44100L AS sample_rate", "500L AS start_pts"
    )
    return timejobs.clock_pts(cb).select("session_id", "seq", "total_samples", "clock_pts")


_PRES = (
    "pr AS (SELECT session_id, (video_pts - audio_pts) * 1000000000 // 90000 AS d, CAST(1001 AS BIGINT) * 1000000000 // 30000 AS len FROM av_samples)"
)


@q("d12_classify_presentation", "av_samples",
   "SELECT session_id, CASE WHEN d < -len THEN 'Drop' WHEN d > 8333333 THEN 'Hold' ELSE 'Present' END AS action, count(*) AS frames FROM pr GROUP BY 1, 2", _PRES)
def _(lib):
    frames = lib.av_samples.selectExpr(
        "session_id", "video_pts AS frame_pts", "audio_pts AS clock_pts", "30000L AS fps_num", "1001L AS fps_den"
    )
    out = timejobs.classify_presentation(frames, 16_666_666)
    return out.groupBy("session_id", "action").agg(F.count(F.lit(1)).alias("frames"))


@q("d13_progress_eta", "",
   "SELECT job_id, round(coalesce(CASE WHEN e > 0 THEN d / e END, 0), 6) AS fps, round(CASE WHEN d < 5 OR d >= t OR (e > 0 AND d / e < 0.001e0) THEN NULL WHEN e <= 0 THEN 0 ELSE (t - d) / (d / e) END, 6) AS eta_s "
   "FROM (SELECT o_orderkey AS job_id, o_orderkey % 100 AS d, 90 AS t, floor(o_totalprice / 1000) * (CASE WHEN o_custkey % 9 = 0 THEN 0 WHEN o_custkey % 9 = 1 THEN 1000 ELSE 1 END) AS e FROM orders)")
def _(lib):
    up = lib.raw("orders").selectExpr(
        "o_orderkey AS job_id", "o_orderkey % 100 AS frames_done", "90 AS total_frames",
        "floor(o_totalprice / 1000) * (CASE WHEN o_custkey % 9 = 0 THEN 0 WHEN o_custkey % 9 = 1 THEN 1000 ELSE 1 END) AS elapsed_s",
    )
    out = timejobs.progress_eta(up)
    return out.select("job_id", rounded(F.col("fps")).alias("fps"), rounded(F.col("eta_s")).alias("eta_s"))
