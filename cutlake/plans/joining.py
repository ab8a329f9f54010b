"""Queries: filters (f*), joins (j*) and the frame manifest (t1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.functions.timebase import frame_at
from cutlake.operators import filters, joins
from cutlake.plans.registry import REGISTRY, Lib

q = REGISTRY.add

STEP = 180_000  # ticks between the sampled frames

POINTS = (
    "points AS (SELECT project_id, unnest(range(0, m + 1, %d)) AS pts FROM "
    "(SELECT project_id, max(pts_out) AS m FROM clips GROUP BY project_id))" % STEP
)
TRACKS = (
    "tracks AS (SELECT DISTINCT project_id, track_id, CASE WHEN track_id = 4 THEN 'Audio' ELSE 'Video' END AS kind, "
    "(project_id + track_id) % 5 = 3 AS mute, project_id % 3 = 0 AND track_id IN (1, 2) AS solo, "
    "1e0 - track_id / 8e0 AS gain, (track_id - 2) / 4e0 AS pan FROM clips)"
)


def points(lib: Lib, step: int = STEP) -> DataFrame:
    """Every step-th tick of each project up to its last clip end."""
    ends = lib.clips.groupBy("project_id").agg(F.max("pts_out").alias("m"))
    block = step * 4096
    blocks = ends.select("project_id", "m", F.explode(F.expr(f"sequence(0L, m, {block}L)")).alias("__first"))
    spread = blocks.repartition("project_id", "__first")
    last = F.least(F.col("__first") + (block - step), F.col("m"))
    return spread.select("project_id", F.explode(F.sequence("__first", last, F.lit(step).cast("bigint"))).alias("pts"))


# Each project's own media: the ids repeat from project to project, what they name does not.
_POOL = (
    "project_id", "source_id", "CASE WHEN (source_id + project_id) % 3 = 0 THEN source_id + 1000 * project_id + 1000 END AS proxy_id",
    "(source_id + project_id) % 4 <> 0 AS has_audio", "concat('/p', project_id, '/', source_id) AS path", "'Offline' AS status",
)
_POOLED = "(source_id + project_id) % 5 <> 0"


def pool_sql(table: str) -> str:
    return f"pool AS (SELECT DISTINCT {', '.join(_POOL)} FROM {table} WHERE {_POOLED})"


def pool(table: DataFrame) -> DataFrame:
    """Media of the projects in a clip table."""
    return table.where(_POOLED).selectExpr(*_POOL).distinct()


def tracks(lib: Lib) -> DataFrame:
    """Track table of the projects."""
    return (
        lib.clips.select("project_id", "track_id")
        .distinct()
        .selectExpr(
            "*",
            "CASE WHEN track_id = 4 THEN 'Audio' ELSE 'Video' END AS kind",
            "(project_id + track_id) % 5 = 3 AS mute",
            "project_id % 3 = 0 AND track_id IN (1, 2) AS solo",
            "1e0 - track_id / 8e0 AS gain",
            "(track_id - 2) / 4e0 AS pan",
        )
    )


_SPEED_U = "CAST(round(c.speed * 10000) AS BIGINT)"


def half_away(num: str, den: str) -> str:
    return f"((CASE WHEN {num} >= 0 THEN {num} + {den} // 2 ELSE {num} - {den} // 2 END) // {den})"


ACTIVE = (
    "active AS (SELECT p.project_id, p.pts, c.clip_id, c.track_id, c.layer_order, c.source_id, c.opacity, c.kind, "
    + half_away(f"((p.pts - c.pts_in) * {_SPEED_U})", "10000")
    + " + c.source_in AS source_pts FROM points p JOIN clips c ON p.project_id = c.project_id "
    "AND c.pts_in <= p.pts AND p.pts < c.pts_out)"
)


@q("f1_active_tracks", "clips",
   "SELECT t.project_id, t.track_id FROM tracks t JOIN (SELECT project_id, bool_or(solo) s FROM tracks GROUP BY 1) a "
   "USING (project_id) WHERE NOT mute AND (NOT s OR solo)", TRACKS)
def _(lib):
    return filters.active_tracks(tracks(lib)).select("project_id", "track_id")


@q("f2_visual_clips", "clips",
   "SELECT c.project_id, c.clip_id, c.track_id FROM clips c LEFT JOIN tracks t USING (project_id, track_id) "
   "WHERE t.kind IS DISTINCT FROM 'Audio'", TRACKS)
def _(lib):
    return filters.visual_clips(lib.clips, tracks(lib)).select("project_id", "clip_id", "track_id")


@q("f3_clips_overlapping", "clips",
   "SELECT project_id, clip_id, pts_in, pts_out FROM clips WHERE pts_in < 120000000 AND pts_out > 90000000")
def _(lib):
    return filters.clips_overlapping(lib.clips, 90_000_000, 120_000_000).select(
        "project_id", "clip_id", "pts_in", "pts_out"
    )


_RANGES = "ranges AS (SELECT project_id, clip_id AS range_id, pts_in // 40 AS start_pts, pts_out // 40 AS end_pts FROM clips)"


@q("f4_markers_in_range", "clips markers",
   "SELECT r.project_id, r.range_id, m.marker_id, m.pts FROM ranges r JOIN markers m ON r.project_id = m.project_id "
   "AND m.pts < r.end_pts AND m.pts + coalesce(m.duration_pts, 0) >= r.start_pts", _RANGES)
def _(lib):
    ranges = lib.clips.selectExpr(
        "project_id", "clip_id AS range_id", "pts_in div 40 AS start_pts", "pts_out div 40 AS end_pts"
    )
    return filters.markers_in_range(lib.markers, ranges).select(
        "project_id", "range_id", "marker_id", "pts"
    )


@q("f5_enabled_effects", "",
   "SELECT l_orderkey AS clip_id, l_linenumber AS position, l_shipdate AS kind_date FROM lineitem WHERE l_linestatus = 'F'")
def _(lib):
    fx = lib.raw("lineitem").selectExpr(
        "l_orderkey AS clip_id", "l_linenumber AS position", "l_shipdate AS kind_date",
        "l_linestatus = 'F' AS enabled",
    )
    return filters.enabled_effects(fx).select("clip_id", "position", "kind_date")


_LISTING = "listing AS (SELECT DISTINCT path FROM sources WHERE matrix_raw <> 3)"


@q("f6_refresh_media_status", "sources",
   "SELECT s.source_id, CASE WHEN l.path IS NULL THEN 'Missing' WHEN s.status = 'Missing' THEN 'Available' "
   "ELSE s.status END AS status FROM sources s LEFT JOIN listing l USING (path)", _LISTING)
def _(lib):
    listing = lib.sources.where("matrix_raw <> 3").select("path")
    return filters.refresh_media_status(lib.sources, listing).select("source_id", "status")


@q("f6_offline_sources", "sources",
   "SELECT source_id, path FROM sources WHERE path NOT IN (SELECT path FROM listing)", _LISTING)
def _(lib):
    listing = lib.sources.where("matrix_raw <> 3").select("path")
    return filters.offline_sources(lib.sources, listing).select("source_id", "path")


_CODES = (
    "raw AS (SELECT source_id, width, height, CASE WHEN bit_depth = 0 THEN 8 ELSE bit_depth END AS bit_depth, "
    "CASE matrix_raw WHEN 1 THEN 'Bt709' WHEN 5 THEN 'Bt601' WHEN 6 THEN 'Bt601' WHEN 9 THEN 'Bt2020' WHEN 10 THEN 'Bt2020' ELSE 'Unknown' END AS m, "
    "CASE range_raw WHEN 1 THEN 'Limited' WHEN 2 THEN 'Full' ELSE 'Unknown' END AS rg, "
    "CASE pri_raw WHEN 1 THEN 'Bt709' WHEN 9 THEN 'Bt2020' ELSE 'Unknown' END AS p, "
    "CASE trc_raw WHEN 1 THEN 'Bt709' WHEN 8 THEN 'Linear' WHEN 13 THEN 'Srgb' WHEN 14 THEN 'Bt2020' WHEN 15 THEN 'Bt2020' "
    "WHEN 16 THEN 'Pq' WHEN 18 THEN 'Hlg' ELSE 'Unknown' END AS t FROM sources), "
    "mat AS (SELECT *, CASE WHEN m <> 'Unknown' THEN m WHEN p = 'Bt2020' OR t IN ('Pq','Hlg','Bt2020') OR width >= 3840 OR height >= 2160 THEN 'Bt2020' "
    "WHEN width > 0 AND width < 1280 AND height > 0 AND height < 720 THEN 'Bt601' ELSE 'Bt709' END AS matrix FROM raw), "
    "color AS (SELECT source_id, width, height, bit_depth, matrix, CASE rg WHEN 'Unknown' THEN 'Limited' ELSE rg END AS \"range\", "
    "CASE WHEN p <> 'Unknown' THEN p WHEN matrix = 'Bt2020' THEN 'Bt2020' ELSE 'Bt709' END AS primaries, "
    "CASE WHEN t <> 'Unknown' THEN t WHEN matrix = 'Bt2020' AND bit_depth >= 10 THEN 'Pq' ELSE 'Bt709' END AS transfer_fn FROM mat)"
)


@q("f7_resolve_color", "sources",
   'SELECT source_id, matrix, "range", primaries, transfer_fn, bit_depth FROM color', _CODES)
def _(lib):
    return filters.resolve_color(lib.sources).select(
        "source_id", "matrix", "range", "primaries", "transfer_fn", "bit_depth"
    )


@q("f8_validate_jobs", "jobs",
   "SELECT job_id, CASE WHEN pts_in >= pts_out THEN 'NegativeDuration' WHEN width = 0 OR height = 0 THEN 'ZeroDimension' "
   "WHEN fps_num = 0 OR fps_den = 0 THEN 'ZeroFrameRate' WHEN threads = 0 THEN 'ZeroThreads' "
   "WHEN quality = 'Crf' AND codec NOT IN ('H264','H265') THEN 'CrfNotSupported' "
   "WHEN transfer IN ('Pq','Hlg') AND codec NOT IN ('H265','ProRes','Vp9') THEN 'HdrNotSupported' "
   "WHEN output_dir = '/out/MACHINERY' THEN 'BadOutputPath' END AS error FROM jobs")
def _(lib):
    folders = lib.jobs.select("output_dir").distinct().where("output_dir <> '/out/MACHINERY'")
    return filters.validate_jobs(lib.jobs, folders).select("job_id", "error")


@q("j1_active_at", "clips", "SELECT project_id, pts, clip_id, source_pts FROM active", f"{POINTS}, {ACTIVE}")
def _(lib):
    return joins.active_at(points(lib), lib.clips).select("project_id", "pts", "clip_id", "source_pts")


@q("j1_active_at_two_grids", "clips", "SELECT project_id, pts, clip_id, source_pts FROM active", f"{POINTS}, {ACTIVE}")
def _(lib):
    hits = joins.active_at(points(lib), lib.clips, width=1 << 14, long_width=1 << 20)
    return hits.select("project_id", "pts", "clip_id", "source_pts")


@q("j2_active_on_track", "clips",
   "SELECT project_id, pts, clip_id, source_pts FROM active WHERE track_id = 2", f"{POINTS}, {ACTIVE}")
def _(lib):
    hits = joins.active_on_track(points(lib), lib.clips, 2)
    return hits.select("project_id", "pts", "clip_id", "source_pts")


@q("j3_overlap_join", "clips",
   "SELECT a.project_id, a.clip_id, b.clip_id AS other_clip_id FROM clips a JOIN clips b ON a.project_id = b.project_id "
   "AND a.pts_in < b.pts_out AND b.pts_in < a.pts_out AND a.clip_id < b.clip_id")
def _(lib):
    narrow = lib.clips.select("project_id", "clip_id", "pts_in", "pts_out")
    pairs = joins.overlap_join(narrow, narrow)
    return pairs.where("clip_id < b_clip_id").select(
        "project_id", "clip_id", F.col("b_clip_id").alias("other_clip_id")
    )


_KQ = "kq AS (SELECT DISTINCT project_id, clip_id, param, pts + (pts % 7 - 3) * 50000000 AS pts FROM keyframes)"


def _keyframe_value(queries: str) -> str:
    return (
        f"kv AS (SELECT s.project_id, s.clip_id, s.param, s.pts, CASE WHEN s.kp IS NULL THEN n.value "
        "WHEN n.pts IS NULL OR s.kp = s.pts THEN s.kval WHEN s.interp = 'Hold' THEN s.kval "
        "ELSE s.kval + (n.value - s.kval) * ((s.pts - s.kp) / (n.pts - s.kp)) END AS value FROM "
        f"(SELECT u.*, k.pts AS kp, k.value AS kval, k.interp FROM {queries} u ASOF LEFT JOIN keyframes k ON u.project_id = k.project_id "
        "AND u.clip_id = k.clip_id AND u.param = k.param AND u.pts >= k.pts) s ASOF LEFT JOIN keyframes n ON s.project_id = n.project_id "
        "AND s.clip_id = n.clip_id AND s.param = n.param AND s.pts <= n.pts)"
    )


@q("j4_eval_keyframes", "keyframes",
   "SELECT project_id, clip_id, param, pts, round(value, 6) AS value FROM kv", f"{_KQ}, {_keyframe_value('kq')}")
def _(lib):
    queries = lib.keyframes.selectExpr(
        "project_id", "clip_id", "param", "pts + (pts % 7 - 3) * 50000000 AS pts"
    ).distinct()
    out = joins.eval_keyframes(queries, lib.keyframes)
    return out.select("project_id", "clip_id", "param", "pts", rounded(F.col("value")).alias("value"))


@q("j5_nearest_marker", "clips markers",
   "SELECT project_id, pts, CASE WHEN nt IS NULL OR pts - pt <= nt - pts THEN pi ELSE ni END AS marker_id, "
   "CASE WHEN nt IS NULL OR pts - pt <= nt - pts THEN pt ELSE nt END AS marker_pts FROM "
   "(SELECT a.*, m.pts AS nt, m.marker_id AS ni FROM (SELECT p.*, m.pts AS pt, m.marker_id AS pi FROM apts p ASOF LEFT JOIN mk m "
   "ON p.project_id = m.project_id AND p.pts >= m.pts) a ASOF LEFT JOIN mk m ON a.project_id = m.project_id AND a.pts <= m.pts)",
   "apts AS (SELECT project_id, pts_in // 40 AS pts FROM clips), "
   "mk AS (SELECT project_id, pts, min(marker_id) AS marker_id FROM markers GROUP BY 1, 2)")
def _(lib):
    at = lib.clips.selectExpr("project_id", "pts_in div 40 AS pts")
    return joins.nearest_marker(at, lib.markers)


@q("j6_next_boundary", "clips",
   "SELECT p.project_id, p.pts, e.edge AS boundary FROM points p ASOF LEFT JOIN (SELECT project_id, pts_in AS edge FROM clips "
   "UNION SELECT project_id, pts_out FROM clips) e ON p.project_id = e.project_id AND p.pts < e.edge", POINTS)
def _(lib):
    return joins.next_boundary(points(lib), lib.clips)


_J7_EXTRA = (
    "ac AS (SELECT DISTINCT project_id, clip_id, pts + 4500 AS pts FROM keyframes UNION SELECT DISTINCT project_id, clip_id, 0 FROM keyframes), "
    "jq AS (SELECT a.project_id, a.clip_id, k.param, a.pts FROM ac a JOIN (SELECT DISTINCT project_id, clip_id, param FROM keyframes WHERE param <> 'Volume') k USING (project_id, clip_id)), "
)


@q("j7_clip_state_at", "keyframes",
   "SELECT project_id, clip_id, pts, round(coalesce(CASE WHEN count(*) FILTER (param = 'Opacity') > 0 THEN least(greatest(max(CASE param WHEN 'Opacity' THEN value END), 0), 1) END, 0.25), 6) AS opacity, "
   "round(coalesce(max(CASE param WHEN 'PositionX' THEN value END), 0), 6) AS position_x, "
   "round(coalesce(max(CASE param WHEN 'Scale' THEN value END), 1), 6) AS scale_y, "
   "round(coalesce(max(CASE param WHEN 'Rotation' THEN value END), 0), 6) AS rotation, 0.3e0 AS chroma_key_tolerance "
   "FROM ac LEFT JOIN kv USING (project_id, clip_id, pts) GROUP BY ALL",
   _J7_EXTRA + _keyframe_value("jq"))
def _(lib):
    k = lib.keyframes
    # Before the first key of each clip and a little past every key of it.
    active = k.selectExpr("project_id", "clip_id", "explode(array(pts + 4500, 0L)) AS pts").distinct()
    active = active.withColumn("opacity", F.lit(0.25))
    out = joins.clip_state_at(active, k)
    return out.select(
        "project_id", "clip_id", "pts",
        *[rounded(F.col(c)).alias(c) for c in ("opacity", "position_x", "scale_y", "rotation")],
        "chroma_key_tolerance",
    )


@q("j8_resolve_proxy", "clips",
   "SELECT c.project_id, c.clip_id, coalesce(s.proxy_id, c.source_id) AS decode_source_id FROM clips c LEFT JOIN pool s USING (project_id, source_id)",
   pool_sql("clips"))
def _(lib):
    return joins.resolve_proxy(lib.clips, pool(lib.clips)).select("project_id", "clip_id", "decode_source_id")


# Every third relink meets a source; sources of even projects with ids from 150 on are named twice.
_RELINK_COLS = ("project_id", "source_id * 3 AS source_id", "concat('/new', path) AS new_path")
_RELINK_TWICE = ("project_id", "source_id", "CASE WHEN source_id % 7 > 0 THEN concat('/again', path) END AS new_path")
_RELINK = (
    f"{pool_sql('clips')}, rl AS (SELECT {', '.join(_RELINK_COLS)} FROM pool UNION ALL SELECT {', '.join(_RELINK_TWICE)} FROM pool WHERE project_id % 2 = 0 AND source_id >= 150), "
    "rj AS (SELECT r.*, CASE WHEN new_path IS NULL THEN 'MissingPath' WHEN p.project_id IS NULL THEN 'NotFound' WHEN count(*) OVER (PARTITION BY r.project_id, r.source_id) > 1 THEN 'DuplicateEdit' END AS reason "
    "FROM rl r LEFT JOIN (SELECT project_id, source_id FROM pool) p USING (project_id, source_id))"
)


def relinks(sources: DataFrame) -> DataFrame:
    twice = sources.where("project_id % 2 = 0 AND source_id >= 150").selectExpr(*_RELINK_TWICE)
    return sources.selectExpr(*_RELINK_COLS).unionByName(twice)


@q("j9_relink", "clips",
   "SELECT project_id, source_id, coalesce(new_path, path) AS path, CASE WHEN new_path IS NULL THEN status ELSE 'Available' END AS status "
   "FROM pool LEFT JOIN (SELECT * FROM rj WHERE reason IS NULL) USING (project_id, source_id)", _RELINK)
def _(lib):
    sources = pool(lib.clips)
    return joins.relink(sources, relinks(sources))[0].select("project_id", "source_id", "path", "status")


@q("j9_relink_rejects", "clips", "SELECT project_id, source_id, new_path, reason FROM rj WHERE reason IS NOT NULL", _RELINK)
def _(lib):
    sources = pool(lib.clips)
    return joins.relink(sources, relinks(sources))[1]


@q("j10_seek_points", "packets",
   "SELECT t.source_id, t.pts, k.pts AS key_pts, k.seq AS key_seq FROM (SELECT DISTINCT source_id, pts + 40000 AS pts FROM packets) t "
   "ASOF LEFT JOIN (SELECT source_id, pts, min(seq) AS seq FROM packets WHERE is_key = 1 GROUP BY 1, 2) k "
   "ON t.source_id = k.source_id AND t.pts >= k.pts")
def _(lib):
    targets = lib.packets.selectExpr("source_id", "pts + 40000 AS pts").distinct()
    return joins.seek_points(targets, lib.packets)


@q("j11_linked_clips", "strip",
   "SELECT a.project_id, a.clip_id, b.clip_id AS linked_clip_id FROM strip a JOIN strip b USING (project_id, source_id, pts_in) "
   "WHERE a.track_id <> b.track_id")
def _(lib):
    return joins.linked_clips(lib.strip).select("project_id", "clip_id", "linked_clip_id")


@q("j11_link_groups", "strip",
   "SELECT project_id, clip_id, track_id, link_id, n_clips FROM (SELECT project_id, clip_id, track_id, min(clip_id) OVER g AS link_id, count(*) OVER g AS n_clips, min(track_id) OVER g AS low, max(track_id) OVER g AS high "
   "FROM strip WINDOW g AS (PARTITION BY project_id, source_id, pts_in)) WHERE low <> high")
def _(lib):
    return joins.link_groups(lib.strip)


_SNAP = (
    "fr AS (SELECT project_id, clip_id, pts_in, (pts_in + 1500) // 3000 AS i, (pts_out + 1500) // 3000 AS o FROM strip), "
    "mv AS (SELECT project_id, clip_id, i + clip_id % 13 AS n, o - i AS d, (clip_id * 7) % 3000 AS ph, clip_id % 6 + 1 AS th FROM fr), "
    "cand AS (SELECT m.project_id, m.clip_id, struct_pack(diff := abs(m.n + e.s - e.at), p := e.p, c := e.c, j := e.j, t := e.at - e.s) AS b, m.th FROM mv m JOIN LATERAL ("
    "SELECT f.pts_in AS p, f.clip_id AS c, u.j, u.s, u.at FROM fr f, LATERAL (SELECT unnest([0,1,2,3]) AS j, unnest([0, 0, m.d, m.d]) AS s, unnest([f.i, f.o, f.i, f.o]) AS at) u "
    "WHERE f.project_id = m.project_id AND f.clip_id <> m.clip_id AND abs(m.n + u.s - u.at) <= m.th) e ON true "
    "UNION ALL SELECT project_id, clip_id, struct_pack(diff := abs(n - ph), p := 9223372036854775807, c := 9223372036854775807, j := 4, t := ph), th FROM mv "
    "UNION ALL SELECT project_id, clip_id, struct_pack(diff := abs(n + d - ph), p := 9223372036854775807, c := 9223372036854775807, j := 5, t := ph - d), th FROM mv), "
    "bst AS (SELECT project_id, clip_id, min(b) AS b FROM cand WHERE b.diff <= th GROUP BY 1, 2)"
)


@q("j12_snap_targets", "strip",
   "SELECT m.project_id, m.clip_id, CASE WHEN b IS NULL THEN m.n ELSE greatest(b.t, 0) END AS snapped_frame, b IS NOT NULL AS is_snapped "
   "FROM mv m LEFT JOIN bst USING (project_id, clip_id)", _SNAP)
def _(lib):
    clips = lib.strip.select(
        "project_id", "clip_id", "pts_in",
        frame_at(F.col("pts_in"), F.lit(30), F.lit(1)).alias("in_frame"),
        frame_at(F.col("pts_out"), F.lit(30), F.lit(1)).alias("out_frame"),
    )
    moves = clips.selectExpr(
        "project_id", "clip_id", "in_frame + clip_id % 13 AS new_frame", "out_frame - in_frame AS duration_frames",
        "(clip_id * 7) % 3000 AS playhead", "clip_id % 6 + 1 AS threshold",
    )
    return joins.snap_targets(moves, clips).select("project_id", "clip_id", "snapped_frame", "is_snapped")


_SERIES = (
    "sa AS (SELECT frame_id // 10 AS pair_id, frame_id % 10 AS idx, y * 7 + x AS cell, r, g, b FROM pixels), "
    "sb AS (SELECT pair_id, idx + pair_id % 4 - 1 AS idx, cell, r + (cell % 3) / 256e0 AS r, g, b FROM sa), "
    "po AS (SELECT a.pair_id, o.o AS off, max(greatest(abs(a.r - b.r), abs(a.g - b.g), abs(a.b - b.b))) AS delta "
    "FROM sa a, (SELECT unnest(range(-3, 4)) AS o) o, sb b WHERE a.pair_id = b.pair_id AND a.idx + o.o = b.idx AND a.cell = b.cell GROUP BY 1, 2)"
)


@q("j13_align_series", "pixels",
   'SELECT pair_id, CAST(arg_min(off, struct_pack(d := delta, o := off)) AS INTEGER) AS "offset", round(min(delta), 6) AS delta, '
   "round(coalesce(max(CASE WHEN off = 0 THEN delta END), min(delta)), 6) AS delta_aligned FROM po GROUP BY pair_id", _SERIES)
def _(lib):
    a = lib.pixels.selectExpr(
        "frame_id div 10 AS pair_id", "frame_id % 10 AS idx", "y * 7 + x AS cell", "r", "g", "b"
    )
    b = a.selectExpr("pair_id", "idx + pair_id % 4 - 1 AS idx", "cell", "r + (cell % 3) / 256e0 AS r", "g", "b")
    out = joins.align_series(a, b, ["pair_id"])
    return out.select("pair_id", "offset", *[rounded(F.col(c)).alias(c) for c in ("delta", "delta_aligned")])


OTHER = (
    "other AS (SELECT frame_id, x, y, r + (frame_id % 5) / 100e0 AS r, g, b - (x % 2) / 50e0 AS b FROM pixels WHERE NOT (a < 0.7e0 AND x = 3))"
)


def other_render(lib: Lib) -> DataFrame:
    return lib.pixels.where("NOT (a < 0.7e0 AND x = 3)").selectExpr(
        "frame_id", "x", "y", "r + (frame_id % 5) / 100e0 AS r", "g", "b - (x % 2) / 50e0 AS b"
    )


@q("j14_compare_frames", "pixels",
   "SELECT frame_id, round(max(w), 6) AS max_diff, round(avg(t) / 3, 6) AS mean_diff, CAST(count(*) FILTER (w IS NULL) AS BIGINT) AS missing, "
   "count(*) FILTER (w IS NULL) = 0 AND max(w) <= 0.03e0 AS passed FROM (SELECT frame_id, greatest(dr, dg, db) + 0 * dr AS w, dr + dg + db AS t FROM "
   "(SELECT frame_id, abs(p.r - o.r) AS dr, abs(p.g - o.g) AS dg, abs(p.b - o.b) AS db FROM pixels p FULL JOIN other o USING (frame_id, x, y))) GROUP BY frame_id",
   OTHER)
def _(lib):
    out = joins.compare_frames(lib.pixels, other_render(lib), 0.03)
    return out.select(
        "frame_id", rounded(F.col("max_diff")).alias("max_diff"),
        rounded(F.col("mean_diff")).alias("mean_diff"), "missing", "passed",
    )


@q("t1_frame_manifest", "clips",
   "SELECT project_id, pts, clip_id, source_id, layer_order, source_pts, row_number() OVER "
   "(PARTITION BY project_id, pts ORDER BY layer_order, clip_id) AS z FROM active", f"{POINTS}, {ACTIVE}")
def _(lib):
    return joins.frame_manifest(points(lib), lib.clips).select(
        "project_id", "pts", "clip_id", "source_id", "layer_order", "source_pts", "z"
    )
