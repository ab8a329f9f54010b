"""Queries: batch edits of interval tables (e*) and the push boundary (w2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlake.operators import edits
from cutlake.plans.joining import half_away, pool, pool_sql
from cutlake.plans.registry import REGISTRY, Lib

q = REGISTRY.add

SHOWN = ["project_id", "clip_id", "track_id", "pts_in", "pts_out", "source_in", "fade_in_pts", "fade_out_pts", "speed"]
COLS = ", ".join(SHOWN)
ATTRS = "source_id, kind, layer_order, opacity, volume, pan, audio_muted"
TOP = "(SELECT project_id, max(clip_id) AS top FROM strip GROUP BY 1)"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN)


def _renumbered(where: str, what: str = "ed") -> str:
    """Good edits with their new ids."""
    return (
        f"gd AS (SELECT *, top + row_number() OVER (PARTITION BY project_id ORDER BY clip_id) AS new_id FROM {what} JOIN {TOP} USING (project_id) WHERE {where})"
    )


# --- insert ------------------------------------------------------------------

_NEW = (
    "project_id, track_id, source_id, pts_in + 1000 AS pts_in, CASE WHEN audio_muted THEN pts_in ELSE pts_out + 500 END AS pts_out, source_in, kind, layer_order, "
    "opacity, volume, pan, audio_muted, fade_in_pts, fade_out_pts, speed, clip_id AS insert_id"
)


@q("e1_insert_clips", "strip",
   f"SELECT {COLS} FROM strip UNION ALL BY NAME SELECT project_id, top + row_number() OVER (PARTITION BY project_id ORDER BY insert_id) AS clip_id, track_id, pts_in, pts_out, source_in, fade_in_pts, fade_out_pts, speed FROM nw JOIN {TOP} USING (project_id) WHERE pts_in < pts_out",
   f"nw AS (SELECT {_NEW} FROM strip WHERE fade_in_pts = 27000)")
def _(lib):
    new = lib.strip.where("fade_in_pts = 27000").selectExpr(*[c.strip() for c in _split(_NEW)])
    return shown(edits.insert_clips(lib.strip, new).clips)


def _split(exprs: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in exprs:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


# Inserts that cover halves, wholes and runs of clips.
_OVER = (
    "project_id, track_id, source_id, pts_in + 45000 AS pts_in, pts_in + 45000 + CASE WHEN pan > 0.5 THEN 300000 WHEN pan < -0.5 THEN 0 ELSE 30000 END AS pts_out, source_in, kind, layer_order, "
    "opacity, volume, pan, audio_muted, fade_in_pts, fade_out_pts, speed, clip_id AS insert_id"
)
_OVER_SQL = (
    f"nw AS (SELECT * FROM (SELECT {_OVER} FROM strip WHERE volume > 1.2) WHERE pts_in < pts_out), "
    "un AS (SELECT *, -1 AS insert_id FROM strip UNION ALL BY NAME SELECT *, -1 - insert_id AS clip_id FROM nw), "
    "h AS (SELECT u.project_id, u.clip_id, u.pts_in, u.pts_out, n.pts_in AS lo, n.pts_out AS hi, n.insert_id AS k FROM un u JOIN nw n ON u.project_id = n.project_id AND u.track_id = n.track_id "
    "AND u.pts_in < n.pts_out AND n.pts_in < u.pts_out AND n.insert_id > u.insert_id), "
    "pc AS (SELECT * FROM (SELECT project_id, clip_id, greatest(pts_in, coalesce(m, pts_in)) AS pi, least(pts_out, lo) AS po FROM (SELECT *, max(hi) OVER (PARTITION BY project_id, clip_id ORDER BY lo, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h) "
    "UNION ALL SELECT project_id, clip_id, greatest(any_value(pts_in), max(hi)), any_value(pts_out) FROM h GROUP BY 1, 2 "
    "UNION ALL SELECT project_id, clip_id, pts_in, pts_out FROM un WHERE (project_id, clip_id) NOT IN (SELECT (project_id, clip_id) FROM h)) WHERE pi < po), "
    "pp AS (SELECT p.*, u.* EXCLUDE (project_id, clip_id, pts_in, pts_out), u.pts_in AS u_in, u.pts_out AS u_out, row_number() OVER (PARTITION BY p.project_id, p.clip_id ORDER BY pi) AS nth FROM pc p JOIN un u USING (project_id, clip_id)), "
    f"rs AS (SELECT project_id, clip_id, false AS fresh, pi, po, * EXCLUDE (project_id, clip_id, pi, po) FROM pp WHERE insert_id < 0 AND nth = 1 UNION ALL SELECT project_id, top + row_number() OVER (PARTITION BY project_id ORDER BY pi, clip_id), true, pi, po, * EXCLUDE (project_id, clip_id, pi, po, top) FROM pp JOIN {TOP} USING (project_id) WHERE insert_id >= 0 OR nth > 1)"
)


@q("e2_insert_overwrite", "strip",
   "SELECT project_id, clip_id, track_id, pi AS pts_in, po AS pts_out, source_in + pi - u_in AS source_in, CASE WHEN pi = u_in THEN fade_in_pts ELSE 0 END AS fade_in_pts, CASE WHEN po = u_out THEN fade_out_pts ELSE 0 END AS fade_out_pts, speed FROM rs",
   _OVER_SQL)
def _(lib):
    new = lib.strip.where("volume > 1.2").selectExpr(*_split(_OVER))
    return shown(edits.insert_overwrite(lib.strip, new).clips)


@q("e2_insert_overwrite_keyframes", "strip strip_keyframes",
   "SELECT project_id, clip_id, param, pts, value FROM strip_keyframes SEMI JOIN (SELECT * FROM rs WHERE NOT fresh AND pi = u_in AND po = u_out) USING (project_id, clip_id)", _OVER_SQL)
def _(lib):
    new = lib.strip.where("volume > 1.2").selectExpr(*_split(_OVER))
    out = edits.insert_overwrite(lib.strip, new, lib.strip_keyframes).keyframes
    return out.select("project_id", "clip_id", "param", "pts", "value")


# --- remove, move, trim, split ----------------------------------------------

_EDITS = "ed AS (SELECT * FROM strip WHERE audio_muted OR opacity > 0.85)"


def picked(lib: Lib, *extra: str, where: str = "audio_muted OR opacity > 0.85") -> DataFrame:
    return lib.strip.where(where).selectExpr("project_id", "clip_id", *extra)


@q("e3_remove_clips", "strip",
   f"SELECT {COLS} FROM strip ANTI JOIN ed USING (project_id, clip_id)", _EDITS)
def _(lib):
    return shown(edits.remove_clips(lib.strip, picked(lib)).clips)


@q("e3_remove_clips_rejects", "strip",
   "SELECT project_id, clip_id, 'DuplicateEdit' AS reason FROM ed WHERE audio_muted UNION ALL SELECT project_id, clip_id, 'DuplicateEdit' FROM ed WHERE audio_muted "
   "UNION ALL SELECT project_id, clip_id + 1000000000, 'ClipNotFound' FROM ed", _EDITS)
def _(lib):
    e = picked(lib)
    twice = picked(lib, where="audio_muted")
    ghost = e.withColumn("clip_id", F.col("clip_id") + 1_000_000_000)
    return edits.remove_clips(lib.strip, e.unionByName(twice).unionByName(ghost)).rejects


@q("e4_move_clips", "strip",
   "SELECT s.project_id, coalesce(g.new_id, s.clip_id) AS clip_id, s.track_id, s.pts_in + CASE WHEN g.new_id IS NULL THEN 0 ELSE 123456 END AS pts_in, s.pts_out + CASE WHEN g.new_id IS NULL THEN 0 ELSE 123456 END AS pts_out, "
   "s.source_in, s.fade_in_pts, s.fade_out_pts, s.speed FROM strip s LEFT JOIN gd g USING (project_id, clip_id)", f"{_EDITS}, {_renumbered('true')}")
def _(lib):
    return shown(edits.move_clips(lib.strip, picked(lib, "pts_in + 123456 AS new_pts_in")).clips)


@q("e4_move_keyframes", "strip strip_keyframes",
   "SELECT k.project_id, coalesce(g.new_id, k.clip_id) AS clip_id, k.param, k.pts + CASE WHEN g.new_id IS NULL THEN 0 ELSE 123456 END AS pts, k.value FROM strip_keyframes k LEFT JOIN gd g USING (project_id, clip_id)", f"{_EDITS}, {_renumbered('true')}")
def _(lib):
    out = edits.move_clips(lib.strip, picked(lib, "pts_in + 123456 AS new_pts_in"), lib.strip_keyframes)
    return out.keyframes.select("project_id", "clip_id", "param", "pts", "value")


_TRIM = "ed AS (SELECT *, pts_in + (clip_id % 12) * 12000 - 36000 AS t FROM strip WHERE audio_muted OR opacity > 0.85)"
_TRIM_OK = "t < pts_out AND source_in + t - pts_in >= 0"
_TRIM_EDIT = "pts_in + (clip_id % 12) * 12000 - 36000"


@q("e5_trim_in", "strip",
   "SELECT s.project_id, coalesce(g.new_id, s.clip_id) AS clip_id, s.track_id, coalesce(g.t, s.pts_in) AS pts_in, s.pts_out, s.source_in + coalesce(g.t - s.pts_in, 0) AS source_in, s.fade_in_pts, s.fade_out_pts, s.speed "
   "FROM strip s LEFT JOIN gd g USING (project_id, clip_id)", f"{_TRIM}, {_renumbered(_TRIM_OK)}")
def _(lib):
    return shown(edits.trim_in(lib.strip, picked(lib, f"{_TRIM_EDIT} AS new_pts_in")).clips)


@q("e5_trim_in_keyframes", "strip strip_keyframes",
   "SELECT k.project_id, coalesce(g.new_id, k.clip_id) AS clip_id, k.param, k.pts, k.value FROM strip_keyframes k LEFT JOIN gd g USING (project_id, clip_id) WHERE g.t IS NULL OR k.pts BETWEEN g.t AND g.pts_out", f"{_TRIM}, {_renumbered(_TRIM_OK)}")
def _(lib):
    out = edits.trim_in(lib.strip, picked(lib, f"{_TRIM_EDIT} AS new_pts_in"), lib.strip_keyframes)
    return out.keyframes.select("project_id", "clip_id", "param", "pts", "value")


@q("e5_trim_in_rejects", "strip",
   f"SELECT project_id, clip_id, CASE WHEN t >= pts_out THEN 'TrimPastOppositeEnd' ELSE 'SourceInBeforeStart' END AS reason FROM ed WHERE NOT ({_TRIM_OK})", _TRIM)
def _(lib):
    out = edits.trim_in(lib.strip, picked(lib, f"{_TRIM_EDIT} AS new_pts_in"))
    return out.rejects.select("project_id", "clip_id", "reason")


@q("e5_trim_out", "strip",
   "SELECT s.project_id, s.clip_id, s.track_id, s.pts_in, CASE WHEN e.t > s.pts_in THEN e.t ELSE s.pts_out END AS pts_out, s.source_in, s.fade_in_pts, s.fade_out_pts, s.speed FROM strip s LEFT JOIN ed e USING (project_id, clip_id)", _TRIM)
def _(lib):
    return shown(edits.trim_out(lib.strip, picked(lib, f"{_TRIM_EDIT} AS new_pts_out")).clips)


_SU = "CAST(round(speed * 10000) AS BIGINT)"
_SPLIT_SQL = (
    f"{_TRIM}, {_renumbered('t > pts_in AND t < pts_out')}, "
    "sg AS (SELECT s.*, g.t, g.new_id FROM strip s LEFT JOIN gd g USING (project_id, clip_id))"
)


@q("e6_split_clips", "strip",
   f"SELECT {COLS} FROM (SELECT * EXCLUDE (t, new_id) FROM sg WHERE t IS NULL UNION ALL BY NAME SELECT * EXCLUDE (t, new_id) REPLACE (t AS pts_out, 0 AS fade_out_pts) FROM sg WHERE t IS NOT NULL UNION ALL BY NAME "
   "SELECT * EXCLUDE (t, new_id) REPLACE (t AS pts_in, new_id AS clip_id, 0 AS fade_in_pts, source_in + " + half_away(f"((t - pts_in) * {_SU})", "10000") + " AS source_in) FROM sg WHERE t IS NOT NULL)", _SPLIT_SQL)
def _(lib):
    return shown(edits.split_clips(lib.strip, picked(lib, f"{_TRIM_EDIT} AS split_pts")).clips)


@q("e6_split_keyframes", "strip strip_keyframes",
   "SELECT k.project_id, k.clip_id, param, pts, value FROM strip_keyframes k LEFT JOIN sg USING (project_id, clip_id) WHERE t IS NULL OR pts BETWEEN pts_in AND t UNION ALL "
   "SELECT k.project_id, new_id, param, pts, value FROM strip_keyframes k JOIN sg USING (project_id, clip_id) WHERE t IS NOT NULL AND pts BETWEEN t AND pts_out", _SPLIT_SQL)
def _(lib):
    out = edits.split_clips(lib.strip, picked(lib, f"{_TRIM_EDIT} AS split_pts"), lib.strip_keyframes)
    return out.keyframes.select("project_id", "clip_id", "param", "pts", "value")


# --- ripple ------------------------------------------------------------------

_CLOSED = (
    "closed AS (SELECT s.* REPLACE (s.pts_in - s.sh AS pts_in, s.pts_out - s.sh AS pts_out) FROM (SELECT s.*, coalesce((SELECT sum(e.pts_out - e.pts_in) FROM ed e WHERE e.project_id = s.project_id "
    "AND e.track_id = s.track_id AND e.pts_out <= s.pts_in), 0)::BIGINT AS sh FROM strip s ANTI JOIN ed USING (project_id, clip_id)) s)"
)


@q("e7_ripple_remove", "strip", f"SELECT {COLS} FROM closed", f"{_EDITS}, {_CLOSED}")
def _(lib):
    return shown(edits.ripple_remove(lib.strip, picked(lib)).clips)


@q("e7_ripple_remove_keyframes", "strip strip_keyframes",
   "SELECT k.project_id, k.clip_id, k.param, k.pts - (s.pts_in - c.pts_in) AS pts, k.value FROM strip_keyframes k JOIN closed c USING (project_id, clip_id) JOIN strip s USING (project_id, clip_id)", f"{_EDITS}, {_CLOSED}")
def _(lib):
    out = edits.ripple_remove(lib.strip, picked(lib), lib.strip_keyframes)
    return out.keyframes.select("project_id", "clip_id", "param", "pts", "value")


def _ripple(src: str, n: str = "") -> str:
    """CTEs for one ripple insert per project of ``nw`` into ``src``; result in ``rip``. ``n`` ends their names."""
    text = (
        f"af AS (SELECT s.project_id, s.clip_id, s.track_id, s.source_id, s.pts_in, n.pts_in AS p, n.pts_out - n.pts_in AS d, s.pts_out - greatest(s.pts_in, n.pts_in) AS len FROM {src} s JOIN nw n USING (project_id, track_id) WHERE s.pts_out > n.pts_in), "
        "dd AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY project_id ORDER BY pts_in, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM af), "
        "pu AS (SELECT *, ahead + greatest(p + d, max(CASE WHEN pts_in >= p THEN pts_in - ahead END) OVER (PARTITION BY project_id ORDER BY pts_in, clip_id)) AS new_in FROM dd), "
        "ps AS (SELECT *, pts_in < p AS split FROM pu WHERE pts_in < p OR new_in > pts_in), "
        "ld AS (SELECT project_id, source_id, pts_in, arg_min(struct_pack(p := p, new_in := new_in, split := split, track := track_id), clip_id) AS l FROM ps GROUP BY 1, 2, 3), "
        "pl AS (SELECT s.*, CASE WHEN o.p IS NOT NULL THEN o.p WHEN l.track <> s.track_id THEN l.p END AS p, CASE WHEN o.p IS NOT NULL THEN o.new_in WHEN l.track <> s.track_id THEN l.new_in END AS ni, "
        f"CASE WHEN o.p IS NOT NULL THEN o.split WHEN l.track <> s.track_id THEN l.split END AS sp FROM {src} s LEFT JOIN ps o ON o.project_id = s.project_id AND o.clip_id = s.clip_id LEFT JOIN ld ON ld.project_id = s.project_id AND ld.source_id = s.source_id AND ld.pts_in = s.pts_in), "
        "fr AS (SELECT * EXCLUDE (p, ni, sp) REPLACE (ni AS pts_in, ni + pts_out - p AS pts_out, source_in + p - pts_in AS source_in, 0 AS fade_in_pts), clip_id AS parent FROM pl WHERE sp AND pts_out > p UNION ALL BY NAME SELECT *, -1 AS parent FROM nw), "
        "rip AS (SELECT * EXCLUDE (p, ni, sp) REPLACE (p AS pts_out, 0 AS fade_out_pts) FROM pl WHERE sp AND pts_out > p UNION ALL BY NAME "
        "SELECT * EXCLUDE (p, ni, sp) REPLACE (CASE WHEN NOT sp THEN ni ELSE pts_in END AS pts_in, CASE WHEN NOT sp THEN pts_out + ni - pts_in ELSE pts_out END AS pts_out) FROM pl WHERE sp IS NULL OR NOT sp OR pts_out <= p "
        f"UNION ALL BY NAME SELECT * EXCLUDE (top, parent, clip_id), top + row_number() OVER (PARTITION BY project_id ORDER BY pts_in, parent) AS clip_id FROM fr JOIN (SELECT project_id, max(clip_id) AS top FROM {src} GROUP BY 1) USING (project_id))"
    )
    return re.sub(r"\b(af|dd|pu|ps|ld|pl|fr|rip|nw)\b", rf"\g<1>{n}", text) if n else text


_RIPPLE_NEW = (
    "project_id, CAST(project_id % 4 AS INT) AS track_id, CAST(7 AS BIGINT) AS source_id, project_id * 1000 + 45000 AS pts_in, project_id * 1000 + 45000 + 250000 AS pts_out, "
    "CAST(0 AS BIGINT) AS source_in, 'Video' AS kind, CAST(0 AS INT) AS layer_order, 1e0 AS opacity, 1e0 AS volume, 0e0 AS pan, false AS audio_muted, "
    "CAST(0 AS BIGINT) AS fade_in_pts, CAST(0 AS BIGINT) AS fade_out_pts, 1e0 AS speed"
)


def ripple_new(lib: Lib) -> DataFrame:
    return lib.strip.select("project_id").distinct().selectExpr(*_split(_RIPPLE_NEW))


@q("e8_ripple_insert", "strip", f"SELECT {COLS} FROM rip", f"nw AS (SELECT {_RIPPLE_NEW} FROM (SELECT DISTINCT project_id FROM strip)), {_ripple('strip')}")
def _(lib):
    return shown(edits.ripple_insert(lib.strip, ripple_new(lib)).clips)


@q("w2_push_boundary", "strip", "SELECT project_id, clip_id, new_in FROM pu", f"nw AS (SELECT {_RIPPLE_NEW} FROM (SELECT DISTINCT project_id FROM strip)), {_ripple('strip')}")
def _(lib):
    at = ripple_new(lib).selectExpr("project_id", "track_id", "pts_in AS p", "pts_out - pts_in AS d")
    return edits.push_boundary(lib.strip, at).select("project_id", "clip_id", "new_in")


# One clip per project moves, half of them to another track.
_RM = (
    "ed AS (SELECT s.*, CAST((s.track_id + project_id % 2) % 5 AS INT) AS new_track, 3600000 + project_id * 500 AS new_pts_in FROM strip s JOIN (SELECT project_id, min(clip_id) AS clip_id FROM strip WHERE opacity > 0.85 GROUP BY 1) USING (project_id, clip_id)), "
    "nw AS (SELECT * EXCLUDE (new_track, new_pts_in, clip_id) REPLACE (new_track AS track_id, new_pts_in AS pts_in, new_pts_in + pts_out - pts_in AS pts_out) FROM ed)"
)


@q("e9_ripple_move", "strip", f"SELECT {COLS} FROM rip", f"{_RM}, {_CLOSED}, {_ripple('closed')}")
def _(lib):
    first = lib.strip.where("opacity > 0.85").groupBy("project_id").agg(F.min("clip_id").alias("clip_id"))
    moves = lib.strip.join(first, ["project_id", "clip_id"]).selectExpr(
        "project_id", "clip_id", "CAST((track_id + project_id % 2) % 5 AS INT) AS new_track", "3600000 + project_id * 500 AS new_pts_in"
    )
    return shown(edits.ripple_move(lib.strip, moves).clips)


# Odd projects ask for two moves, and keep both clips; a third asks for an unknown clip.
_TWO = "project_id % 2 = 1 AND opacity > 0.85"


@q("e9_ripple_move_rejects", "strip",
   "SELECT project_id, clip_id, 'DuplicateEdit' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM two) WHERE n > 1 "
   "UNION ALL SELECT project_id, -1, 'ClipNotFound' FROM (SELECT DISTINCT project_id FROM two)",
   f"two AS (SELECT project_id, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY clip_id) AS k FROM strip WHERE {_TWO}) WHERE k <= 2)")
def _(lib):
    order = Window.partitionBy("project_id").orderBy("clip_id")
    two = lib.strip.where(_TWO).select("project_id", "clip_id", F.row_number().over(order).alias("k")).where("k <= 2").drop("k")
    asked = two.unionByName(two.select("project_id", F.lit(-1).cast("bigint").alias("clip_id")).distinct())
    moves = asked.selectExpr("*", "CAST(1 AS INT) AS new_track", "1000L AS new_pts_in")
    return edits.ripple_move(lib.strip, moves).rejects.select("project_id", "clip_id", "reason")


# Four inserts per project, in an order that isn't that of their places; every third project has one only.
_SEQ = 4
_SEQ_NEW = (
    "project_id, CAST((project_id + k) % 5 AS INT) AS track_id, CAST(7 AS BIGINT) AS source_id, (k * 7919 % 40) * 90000 + project_id * 10 + 45000 AS pts_in, "
    "(k * 7919 % 40) * 90000 + project_id * 10 + 45000 + 50000 * k AS pts_out, CAST(0 AS BIGINT) AS source_in, 'Video' AS kind, CAST(0 AS INT) AS layer_order, "
    "1e0 AS opacity, 1e0 AS volume, 0e0 AS pan, false AS audio_muted, CAST(0 AS BIGINT) AS fade_in_pts, CAST(0 AS BIGINT) AS fade_out_pts, 1e0 AS speed"
)
_SEQ_WHICH = "k = 1 OR project_id % 3 <> 0"


def _chain(step, rounds: int) -> str:
    """CTEs of several rounds, each on the result of the one before."""
    return ", ".join(step("strip" if n == 1 else f"rip{n - 1}", n) for n in range(1, rounds + 1))


def _key_step(src: str, n: int, keys: str, renamed: str = "") -> str:
    """Keys after round ``n``: they go with the clip that keeps its id, up to its end where it was cut."""
    return (
        f"kf{n} AS (SELECT k.project_id, k.clip_id, k.param, k.pts + r.pts_in - s.pts_in AS pts, k.value FROM {keys} k JOIN {src} s USING (project_id, clip_id) JOIN rip{n} r USING (project_id, clip_id) "
        f"WHERE r.pts_out - r.pts_in = s.pts_out - s.pts_in OR k.pts + r.pts_in - s.pts_in <= r.pts_out{renamed})"
    )


def _insert_rounds(keyed: bool = False) -> str:
    def step(src: str, n: int) -> str:
        picked = f"nw{n} AS (SELECT {_SEQ_NEW} FROM (SELECT project_id, {n} AS k FROM strip GROUP BY 1) WHERE {_SEQ_WHICH})"
        key = f", {_key_step(src, n, 'strip_keyframes' if n == 1 else f'kf{n - 1}')}" if keyed else ""
        return f"{picked}, {_ripple(src, str(n))}{key}"

    return _chain(step, _SEQ)


def sequence_new(lib: Lib) -> DataFrame:
    ks = lib.strip.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, range(1, _SEQ + 1)))).alias("k"))
    return ks.where(_SEQ_WHICH).selectExpr(*_split(_SEQ_NEW), "k AS seq")


@q("e8_ripple_insert_sequence", "strip", f"SELECT {COLS}, {ATTRS} FROM rip{_SEQ}", _insert_rounds())
def _(lib):
    return edits.ripple_insert(lib.strip, sequence_new(lib)).clips.select(*SHOWN, *ATTRS.split(", "))


@q("e8_ripple_insert_keyframes", "strip strip_keyframes", f"SELECT project_id, clip_id, param, pts, value FROM kf{_SEQ}", _insert_rounds(True))
def _(lib):
    return edits.ripple_insert(lib.strip, sequence_new(lib), lib.strip_keyframes).keyframes.select("project_id", "clip_id", "param", "pts", "value")


# Three moves per project: the k-th clip by id among some goes to another track for even k.
_MOVES = 3
_MOVE_WHICH = "opacity > 0.85"
_MOVE_TO = "CAST((track_id + (k + 1) % 2) % 5 AS INT) AS new_track, (k * 5 % 11) * 270000 + project_id * 500 AS new_pts_in"


def _move_rounds(keyed: bool = False) -> str:
    mv = f"mv AS (SELECT project_id, clip_id, k, {_MOVE_TO} FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY clip_id) AS k FROM strip WHERE {_MOVE_WHICH}) WHERE k <= {_MOVES})"

    def step(src: str, n: int) -> str:
        moved = f"ed{n} AS (SELECT s.*, new_track, new_pts_in FROM {src} s JOIN mv USING (project_id, clip_id) WHERE k = {n})"
        closed = (
            f"closed{n} AS (SELECT s.* REPLACE (s.pts_in - coalesce(e.gap, 0) AS pts_in, s.pts_out - coalesce(e.gap, 0) AS pts_out) FROM (SELECT * FROM {src} ANTI JOIN ed{n} USING (project_id, clip_id)) s "
            f"LEFT JOIN (SELECT project_id, track_id, pts_out AS gone, pts_out - pts_in AS gap FROM ed{n}) e ON e.project_id = s.project_id AND e.track_id = s.track_id AND e.gone <= s.pts_in)"
        )
        new = f"nw{n} AS (SELECT * EXCLUDE (new_track, new_pts_in, clip_id) REPLACE (new_track AS track_id, new_pts_in AS pts_in, new_pts_in + pts_out - pts_in AS pts_out) FROM ed{n})"
        # Nothing else starts where the moved clip does.
        keys = "strip_keyframes" if n == 1 else f"kf{n - 1}"
        own = (
            f" UNION ALL SELECT k.project_id, r.clip_id, k.param, k.pts + e.new_pts_in - e.pts_in, k.value FROM {keys} k JOIN ed{n} e USING (project_id, clip_id) "
            f"JOIN rip{n} r ON r.project_id = e.project_id AND r.track_id = e.new_track AND r.pts_in = e.new_pts_in"
        )
        # The moved clip's old id may be given anew.
        rest = f"(SELECT * FROM {keys} ANTI JOIN ed{n} USING (project_id, clip_id))"
        key = f", {_key_step(src, n, rest, own)}" if keyed else ""
        return f"{moved}, {closed}, {new}, {_ripple(f'closed{n}', str(n))}{key}"

    return f"{mv}, {_chain(step, _MOVES)}"


def sequence_moves(lib: Lib) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy("clip_id")
    picked = lib.strip.where(_MOVE_WHICH).withColumn("k", F.row_number().over(order)).where(F.col("k") <= _MOVES)
    return picked.selectExpr("project_id", "clip_id", *_split(_MOVE_TO), "CAST(k AS BIGINT) AS seq")


@q("e9_ripple_move_sequence", "strip", f"SELECT {COLS}, {ATTRS} FROM rip{_MOVES}", _move_rounds())
def _(lib):
    return edits.ripple_move(lib.strip, sequence_moves(lib)).clips.select(*SHOWN, *ATTRS.split(", "))


@q("e9_ripple_move_keyframes", "strip strip_keyframes", f"SELECT project_id, clip_id, param, pts, value FROM kf{_MOVES}", _move_rounds(True))
def _(lib):
    return edits.ripple_move(lib.strip, sequence_moves(lib), lib.strip_keyframes).keyframes.select("project_id", "clip_id", "param", "pts", "value")


# --- slip, slide, roll -------------------------------------------------------

_SLIP = "ed AS (SELECT *, (clip_id % 9 - 4) * 20000 AS delta FROM strip WHERE audio_muted OR opacity > 0.85)"


@q("e10_slip", "strip",
   "SELECT s.project_id, s.clip_id, s.track_id, s.pts_in, s.pts_out, CASE WHEN s.source_in + e.delta >= 0 THEN s.source_in + e.delta ELSE s.source_in END AS source_in, s.fade_in_pts, s.fade_out_pts, s.speed FROM strip s LEFT JOIN ed e USING (project_id, clip_id)", _SLIP)
def _(lib):
    return shown(edits.slip(lib.strip, picked(lib, "(clip_id % 9 - 4) * 20000 AS delta")).clips)


_SLIDE = (
    f"{_SLIP}, ok AS (SELECT * FROM ed WHERE pts_in + delta >= 0 AND delta <> 0), "
    "fine AS (SELECT * FROM ok o WHERE NOT EXISTS (SELECT 1 FROM ok n WHERE n.project_id = o.project_id AND n.track_id = o.track_id AND (n.pts_out = o.pts_in OR n.pts_in = o.pts_out)))"
)


@q("e10_slide", "strip",
   "SELECT s.project_id, s.clip_id, s.track_id, s.pts_in + coalesce(o.delta, r.delta, 0) AS pts_in, s.pts_out + coalesce(o.delta, l.delta, 0) AS pts_out, s.source_in + CASE WHEN o.delta IS NULL THEN coalesce(r.delta, 0) ELSE 0 END AS source_in, s.fade_in_pts, s.fade_out_pts, s.speed "
   "FROM strip s LEFT JOIN fine o USING (project_id, clip_id) LEFT JOIN fine l ON l.project_id = s.project_id AND l.track_id = s.track_id AND l.pts_in = s.pts_out LEFT JOIN fine r ON r.project_id = s.project_id AND r.track_id = s.track_id AND r.pts_out = s.pts_in", _SLIDE)
def _(lib):
    return shown(edits.slide(lib.strip, picked(lib, "(clip_id % 9 - 4) * 20000 AS delta")).clips)


@q("e10_slide_rejects", "strip",
   "SELECT project_id, clip_id, CASE WHEN pts_in + delta < 0 THEN 'InvalidDuration' ELSE 'ConflictingEdit' END AS reason FROM ed WHERE pts_in + delta < 0 OR (delta <> 0 AND (project_id, clip_id) NOT IN (SELECT (project_id, clip_id) FROM fine))", _SLIDE)
def _(lib):
    out = edits.slide(lib.strip, picked(lib, "(clip_id % 9 - 4) * 20000 AS delta"))
    return out.rejects.select("project_id", "clip_id", "reason")


_ROLL = (
    "rl AS (SELECT a.project_id, a.clip_id AS left_id, b.clip_id AS right_id, (a.clip_id % 13 - 6) * 20000 AS delta, a.pts_in AS li, a.pts_out AS lo, b.pts_out AS ro, b.source_in AS rs FROM strip a JOIN strip b ON a.project_id = b.project_id AND a.track_id = b.track_id AND a.pts_out = b.pts_in WHERE a.opacity > 0.65), "
    "us AS (SELECT project_id, c, count(*) AS n FROM (SELECT project_id, left_id AS c FROM rl UNION ALL SELECT project_id, right_id FROM rl) GROUP BY 1, 2), "
    "jd AS (SELECT r.*, CASE WHEN u.n > 1 OR v.n > 1 THEN 'DuplicateEdit' WHEN lo + delta <= li OR lo + delta >= ro THEN 'TrimPastOppositeEnd' WHEN rs + delta < 0 THEN 'SourceInBeforeStart' END AS reason "
    "FROM rl r JOIN us u ON u.project_id = r.project_id AND u.c = left_id JOIN us v ON v.project_id = r.project_id AND v.c = right_id), okr AS (SELECT * FROM jd WHERE reason IS NULL)"
)


def rolls(lib: Lib) -> DataFrame:
    a = lib.strip.where("opacity > 0.65").selectExpr(
        "project_id", "track_id", "pts_out AS cut", "clip_id AS left_id", "(clip_id % 13 - 6) * 20000 AS delta"
    )
    b = lib.strip.selectExpr("project_id", "track_id", "pts_in AS cut", "clip_id AS right_id")
    return a.join(b, ["project_id", "track_id", "cut"]).select("project_id", "left_id", "right_id", "delta")


@q("e10_roll", "strip",
   "SELECT s.project_id, s.clip_id, s.track_id, coalesce(r.lo + r.delta, s.pts_in) AS pts_in, coalesce(l.lo + l.delta, s.pts_out) AS pts_out, coalesce(r.rs + r.delta, s.source_in) AS source_in, s.fade_in_pts, s.fade_out_pts, s.speed "
   "FROM strip s LEFT JOIN okr l ON l.project_id = s.project_id AND l.left_id = s.clip_id LEFT JOIN okr r ON r.project_id = s.project_id AND r.right_id = s.clip_id", _ROLL)
def _(lib):
    return shown(edits.roll(lib.strip, rolls(lib)).clips)


@q("e10_roll_rejects", "strip", "SELECT project_id, left_id, right_id, delta, reason FROM jd WHERE reason IS NOT NULL", _ROLL)
def _(lib):
    return edits.roll(lib.strip, rolls(lib)).rejects


# --- duplicate, batch move, attributes ---------------------------------------

_DUP_SQL = _OVER_SQL.replace(
    f"nw AS (SELECT * FROM (SELECT {_OVER} FROM strip WHERE volume > 1.2) WHERE pts_in < pts_out)",
    "nw AS (SELECT * EXCLUDE (clip_id) REPLACE (pts_out AS pts_in, 2 * pts_out - pts_in AS pts_out), clip_id AS insert_id FROM strip WHERE opacity > 0.85)",
)


@q("e11_duplicate", "strip",
   "SELECT project_id, clip_id, track_id, pi AS pts_in, po AS pts_out, source_in + pi - u_in AS source_in, CASE WHEN pi = u_in THEN fade_in_pts ELSE 0 END AS fade_in_pts, CASE WHEN po = u_out THEN fade_out_pts ELSE 0 END AS fade_out_pts, speed FROM rs", _DUP_SQL)
def _(lib):
    return shown(edits.duplicate(lib.strip, picked(lib, where="opacity > 0.85")).clips)


@q("e11_duplicate_to", "strip",
   f"SELECT {COLS} FROM strip UNION ALL BY NAME SELECT project_id, top + row_number() OVER (PARTITION BY project_id ORDER BY clip_id) AS clip_id, CAST(9 AS INTEGER) AS track_id, pts_in + 777 AS pts_in, pts_out + 777 AS pts_out, source_in, fade_in_pts, fade_out_pts, speed FROM ed JOIN {TOP} USING (project_id)", _EDITS)
def _(lib):
    return shown(edits.duplicate_to(lib.strip, picked(lib, "9 AS to_track", "pts_in + 777 AS to_pts_in")).clips)


@q("e11_batch_move", "strip",
   "SELECT s.project_id, s.clip_id, s.track_id, s.pts_in + coalesce(e.d, 0) AS pts_in, s.pts_out + coalesce(e.d, 0) AS pts_out, s.source_in, s.fade_in_pts, s.fade_out_pts, s.speed FROM strip s LEFT JOIN (SELECT *, -500000 AS d FROM ed WHERE pts_in >= 500000) e USING (project_id, clip_id)", _EDITS)
def _(lib):
    return shown(edits.batch_move(lib.strip, picked(lib, "-500000L AS delta")).clips)


@q("e12_update_clips", "strip",
   "SELECT s.project_id, s.clip_id, CASE WHEN e.spd IS NULL OR abs(s.speed - e.spd) <= 0.0001 THEN s.pts_out ELSE s.pts_in + " + half_away("((s.pts_out - s.pts_in) * CAST(round(s.speed * 10000) AS BIGINT))", "CAST(round(e.spd * 10000) AS BIGINT)")
   + " END AS pts_out, coalesce(e.spd, s.speed) AS speed, coalesce(e.op, s.opacity) AS opacity, coalesce(CASE WHEN e.fi IS NOT NULL THEN greatest(e.fi, 0) END, s.fade_in_pts) AS fade_in_pts FROM strip s LEFT JOIN (SELECT * FROM ch WHERE op IS NULL OR op BETWEEN 0 AND 1) e USING (project_id, clip_id)",
   "ch AS (SELECT project_id, clip_id, CASE WHEN clip_id % 2 = 0 THEN opacity + 0.05e0 END AS op, CASE WHEN clip_id % 3 = 0 THEN 1.5e0 END AS spd, CASE WHEN clip_id % 5 <> 0 THEN fade_in_pts - 9000 END AS fi FROM strip WHERE audio_muted OR opacity > 0.85)")
def _(lib):
    changes = picked(
        lib, "CASE WHEN clip_id % 2 = 0 THEN opacity + 0.05e0 END AS opacity", "CASE WHEN clip_id % 3 = 0 THEN 1.5e0 END AS speed", "CASE WHEN clip_id % 5 <> 0 THEN fade_in_pts - 9000 END AS fade_in_pts"
    )
    return edits.update_clips(lib.strip, changes).clips.select("project_id", "clip_id", "pts_out", "speed", "opacity", "fade_in_pts")


# --- integrity, keyframes, layers, versions ----------------------------------

_DEFECTS = (
    "bad AS (SELECT * REPLACE (CASE WHEN audio_muted AND fade_in_pts = 0 THEN pts_in ELSE pts_out + CASE WHEN opacity > 0.95 THEN 20000 ELSE 0 END END AS pts_out, source_in - 3000 AS source_in, CASE WHEN pan > 0.9 THEN 8 ELSE track_id END AS track_id) FROM strip), "
    "rch AS (SELECT *, max(pts_out) OVER (PARTITION BY project_id, track_id ORDER BY pts_in, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(pts_in) OVER (PARTITION BY project_id, track_id ORDER BY pts_in, clip_id) AS pv FROM bad)"
)


@q("e13_check_integrity", "strip strip_keyframes",
   "SELECT project_id, clip_id, 'BadDuration' AS problem FROM bad WHERE pts_in >= pts_out UNION ALL SELECT project_id, clip_id, 'SourceInBeforeStart' FROM bad WHERE source_in < 0 "
   "UNION ALL SELECT project_id, clip_id, 'Overlap' FROM rch WHERE reach > pts_in OR pv = pts_in UNION ALL SELECT project_id, clip_id, 'UnknownTrack' FROM bad WHERE track_id > 4 "
   "UNION ALL SELECT project_id, clip_id, 'UnknownSource' FROM bad ANTI JOIN pool USING (project_id, source_id) UNION ALL SELECT DISTINCT project_id, clip_id, 'OrphanKeyframe' FROM strip_keyframes WHERE clip_id NOT IN (SELECT clip_id FROM bad) "
   "UNION ALL SELECT DISTINCT project_id, clip_id, 'DuplicateKeyframe' FROM (SELECT project_id, clip_id FROM strip_keyframes GROUP BY project_id, clip_id, param, pts HAVING count(*) > 1)", f"{_DEFECTS}, {pool_sql('strip')}")
def _(lib):
    bad = lib.strip.withColumns(
        {
            "pts_out": F.expr("CASE WHEN audio_muted AND fade_in_pts = 0 THEN pts_in ELSE pts_out + CASE WHEN opacity > 0.95 THEN 20000 ELSE 0 END END"),
            "source_in": F.expr("source_in - 3000"),
            "track_id": F.expr("CASE WHEN pan > 0.9 THEN 8 ELSE track_id END"),
        }
    )
    tracks = lib.strip.select("project_id", "track_id").distinct()
    return edits.check_integrity(bad, tracks, pool(lib.strip), lib.strip_keyframes)


_KF = "kf AS (SELECT project_id, clip_id, param, pts, max(value) AS value, min(interp) AS interp FROM strip_keyframes GROUP BY 1, 2, 3, 4)"


def unique_keys(lib: Lib) -> DataFrame:
    return lib.strip_keyframes.groupBy("project_id", "clip_id", "param", "pts").agg(
        F.max("value").alias("value"), F.min("interp").alias("interp")
    )


_OPS = (
    "ops AS (SELECT project_id, clip_id, param, pts + CASE WHEN value > 40 THEN 17 ELSE 0 END AS pts, 1 AS seq, 'set' AS op, value * 2 AS value, 'Hold' AS interp FROM kf WHERE value > 20 UNION ALL "
    "SELECT project_id, clip_id, param, pts, 2, 'remove', NULL, NULL FROM kf WHERE value BETWEEN 30 AND 45), "
    "lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id, param, pts ORDER BY seq DESC) AS rn FROM ops) WHERE rn = 1)"
)


@q("e14_keyframes_apply", "strip_keyframes",
   "SELECT project_id, clip_id, param, pts, CASE WHEN o.op IS NULL THEN k.value ELSE o.value END AS value, CASE WHEN o.op IS NULL THEN k.interp ELSE o.interp END AS interp FROM kf k FULL JOIN lo o USING (project_id, clip_id, param, pts) WHERE o.op IS NULL OR o.op = 'set'", f"{_KF}, {_OPS}")
def _(lib):
    k = unique_keys(lib)
    sets = k.where("value > 20").selectExpr(
        "project_id", "clip_id", "param", "pts + CASE WHEN value > 40 THEN 17 ELSE 0 END AS pts", "1 AS seq", "'set' AS op", "value * 2 AS value", "'Hold' AS interp"
    )
    drops = k.where("value BETWEEN 30 AND 45").selectExpr(
        "project_id", "clip_id", "param", "pts", "2 AS seq", "'remove' AS op", "cast(NULL AS double) AS value", "cast(NULL AS string) AS interp"
    )
    return edits.keyframes_apply(k, sets.unionByName(drops))


@q("e14_keyframes_move", "strip_keyframes",
   "SELECT project_id, clip_id, param, pts + CASE WHEN value > 30 THEN 1000001 ELSE 0 END AS pts, value, interp FROM kf", _KF)
def _(lib):
    k = unique_keys(lib)
    moves = k.where("value > 30").selectExpr("project_id", "clip_id", "param", "pts", "pts + 1000001 AS new_pts")
    return edits.keyframes_move(k, moves)


@q("e14_keyframes_shift_copy", "strip_keyframes",
   "SELECT project_id, clip_id, param, pts, value FROM sh UNION ALL SELECT project_id, clip_id + 1000000000, param, pts, value FROM sh WHERE clip_id % 3 = 0 AND (clip_id % 2 = 1 OR pts BETWEEN 1000000 AND 5000000)",
   f"{_KF}, sh AS (SELECT * REPLACE (pts + CASE WHEN clip_id % 5 = 0 THEN 4242 ELSE 0 END AS pts) FROM kf)")
def _(lib):
    k = unique_keys(lib)
    clips = k.select("project_id", "clip_id").distinct()
    shifted = edits.keyframes_shift(k, clips.where("clip_id % 5 = 0").withColumn("delta", F.lit(4242)))
    copies = clips.where("clip_id % 3 = 0").selectExpr(
        "project_id", "clip_id", "clip_id + 1000000000 AS dest_id",
        "CASE WHEN clip_id % 2 = 0 THEN 1000000 END AS start_pts", "CASE WHEN clip_id % 2 = 0 THEN 5000000 END AS end_pts",
    )
    return edits.keyframes_copy(shifted, copies).select("project_id", "clip_id", "param", "pts", "value")


@q("e15_reindex_layers", "clips",
   "SELECT project_id, clip_id, CAST((CASE WHEN track_id = 3 THEN 0 ELSE 4 - track_id END) * 256 + (row_number() OVER (PARTITION BY project_id, track_id ORDER BY pts_in, clip_id) - 1) % 256 AS INTEGER) AS layer_order FROM clips")
def _(lib):
    tracks = lib.clips.where("track_id <> 3").selectExpr("project_id", "track_id", "4 - track_id AS position").distinct()
    return edits.reindex_layers(lib.clips, tracks).select("project_id", "clip_id", "layer_order")


@q("e16_next_layer_slot", "clips",
   "SELECT t.project_id, t.track_id, CAST(t.track_id * 256 + coalesce(min(s.v) FILTER (c.low IS NULL), 0) AS INTEGER) AS layer_order FROM (SELECT DISTINCT project_id, track_id FROM clips UNION SELECT DISTINCT project_id, 5 FROM clips) t "
   "CROSS JOIN (SELECT unnest(range(256)) AS v) s LEFT JOIN (SELECT DISTINCT project_id, track_id, layer_order % 256 AS low FROM clips) c ON c.project_id = t.project_id AND c.track_id = t.track_id AND c.low = s.v GROUP BY 1, 2")
def _(lib):
    have = lib.clips.select("project_id", "track_id").distinct()
    empty = lib.clips.select("project_id").distinct().withColumn("track_id", F.lit(5))
    tracks = have.unionByName(empty).withColumn("position", F.col("track_id"))
    return edits.next_layer_slot(lib.clips, tracks)


@q("e17_as_of_version", "",
   "SELECT project_id, as_of, max(version) AS version FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY version DESC) AS n FROM (SELECT user_id AS project_id, event_id AS version FROM events)) "
   "JOIN (SELECT user_id AS project_id, CAST(max(event_id) * 4 // 5 AS BIGINT) AS as_of FROM events GROUP BY 1) USING (project_id) WHERE n <= 30 AND version <= as_of GROUP BY 1, 2")
def _(lib):
    snaps = lib.raw("events").selectExpr("user_id AS project_id", "event_id AS version", "props AS json")
    wanted = snaps.groupBy("project_id").agg(F.expr("max(version) * 4 div 5 AS version"))
    return edits.as_of_version(snaps, wanted, 30).select("project_id", "as_of", "version")
