"""Queries: sources and sinks (s*) and text jobs (n*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlake.functions.arith import rounded
from cutlake.operators import textjobs
from cutlake.plans.editing import _split, unique_keys
from cutlake.plans.registry import REGISTRY, Lib
from cutlake.session import scratch_dir
from cutlake.sources import frames, luts, projects, snapshots

q = REGISTRY.add


def project_tables(lib: Lib) -> dict:
    """The strip library as project tables."""
    ids = lib.strip.select("project_id").distinct()
    tracks = lib.strip.select("project_id", "track_id").distinct().selectExpr(
        "project_id", "track_id", "track_id AS position", "CASE WHEN track_id = 4 THEN 'Audio' ELSE 'Video' END AS kind",
        "concat('T', track_id) AS name", "track_id = 3 AS mute", "false AS solo", "false AS locked", "1e0 AS gain", "0e0 AS pan",
    )
    # Project -1 has nothing at all.
    ids = ids.unionByName(lib.spark.createDataFrame([(-1,)], "project_id bigint"))
    return {
        "projects": ids.selectExpr(
            "project_id", "concat('Project ', project_id) AS name", "1920 AS width", "1080 AS height",
            "named_struct('num', 30000L, 'den', 1001L) AS frame_rate", "named_struct('num', 1L, 'den', 90000L) AS timebase",
        ),
        "tracks": tracks,
        "clips": lib.strip,
        "keyframes": unique_keys(lib),
        "sources": lib.strip.select("project_id", "source_id").distinct().selectExpr(
            "project_id", "source_id", "concat('/m/', source_id, '.mov') AS path", "cast(NULL AS bigint) AS proxy_id"
        ),
    }


def round_trip(lib: Lib) -> dict:
    folder = scratch_dir(lib.spark, "projects")
    projects.write_projects(project_tables(lib), folder)
    return projects.read_projects(lib.spark, folder)


_CLIP_COLS = "project_id, clip_id, track_id, source_id, pts_in, pts_out, source_in, kind, layer_order, opacity, volume, pan, audio_muted, fade_in_pts, fade_out_pts, speed"


@q("s1_read_projects_clips", "strip", f"SELECT {_CLIP_COLS}, 'Normal' AS blend_mode FROM strip")
def _(lib):
    return round_trip(lib)["clips"].select(*_CLIP_COLS.split(", "), "blend_mode")


@q("s2_write_projects_keyframes", "strip_keyframes",
   "SELECT project_id, clip_id, param, pts, max(value) AS value, min(interp) AS interp FROM strip_keyframes GROUP BY 1, 2, 3, 4")
def _(lib):
    return round_trip(lib)["keyframes"]


@q("s2_write_projects_tracks", "strip",
   "SELECT DISTINCT project_id, track_id, CAST(track_id AS INTEGER) AS position, CASE WHEN track_id = 4 THEN 'Audio' ELSE 'Video' END AS kind, track_id = 3 AS mute FROM strip")
def _(lib):
    return round_trip(lib)["tracks"].select("project_id", "track_id", "position", "kind", "mute")


@q("s2_write_projects_list", "strip",
   "SELECT project_id, concat('Project ', CAST(project_id AS VARCHAR)) AS name, CAST(1920 AS INTEGER) AS width FROM (SELECT DISTINCT project_id FROM strip UNION ALL SELECT -1)")
def _(lib):
    return round_trip(lib)["projects"].select("project_id", "name", "width")


# Text clips, effects and members that no column is for.
_FIELDS = (
    "project_id, clip_id, CASE WHEN clip_id % 7 = 0 THEN 'Text' ELSE kind END AS kind, CASE WHEN clip_id % 7 = 0 THEN concat('{\"text\":\"Title ', CAST(clip_id AS {text}), '\",\"font_size\":12.5}') END AS payload, "
    "concat('[{\"kind\":\"Blur\",\"radius\":', CAST(clip_id % 5 AS {text}), '}]') AS effects, CASE WHEN clip_id % 3 = 0 THEN '{\"tl\":[0]}' END AS corner_pin, "
    "clip_id % 11 AS effect_start, CAST(clip_id % 4 AS INT) AS effect_count"
)


@q("s1_read_projects_fields", "strip",
   f"SELECT {_FIELDS.replace('{text}', 'VARCHAR')}, concat('\"c', CAST(clip_id AS VARCHAR), '\"') AS label FROM strip")
def _(lib):
    own = lib.strip.selectExpr(*_split(_FIELDS.replace("{text}", "STRING")), "map('label', concat('\"c', clip_id, '\"')) AS more")
    rest = lib.strip.drop("kind")
    folder = scratch_dir(lib.spark, "projects")
    projects.write_projects({**project_tables(lib), "clips": rest.join(own, ["project_id", "clip_id"])}, folder)
    found = projects.read_projects(lib.spark, folder)["clips"]
    return found.selectExpr("project_id", "clip_id", "kind", "payload", "effects", "corner_pin", "effect_start", "effect_count", "more['label'] AS label")


@q("s2_write_projects_orphans", "strip strip_keyframes",
   "SELECT project_id, part, CAST(rows AS BIGINT) AS rows, 'NoProject' AS reason FROM ("
   "SELECT project_id, 'clips' AS part, count(*) AS rows FROM strip GROUP BY 1 UNION ALL SELECT project_id, 'tracks', count(DISTINCT track_id) FROM strip GROUP BY 1 "
   "UNION ALL SELECT project_id, 'sources', count(DISTINCT source_id) FROM strip GROUP BY 1 "
   "UNION ALL SELECT project_id, 'keyframes', count(*) FROM (SELECT DISTINCT project_id, clip_id, param, pts FROM strip_keyframes) GROUP BY 1) WHERE project_id % 2 = 1")
def _(lib):
    tables = project_tables(lib)
    return projects.write_projects({**tables, "projects": tables["projects"].where("project_id % 2 = 0")}, scratch_dir(lib.spark, "projects"))


@q("s3_read_luts", "",
   "SELECT vec_id, CAST(2 AS BIGINT) AS size, CAST(k % 2 AS INTEGER) AS ri, CAST(k // 2 % 2 AS INTEGER) AS gi, CAST(k // 4 AS INTEGER) AS bi, round((CAST(embedding[3*k+1] AS DOUBLE) + 1) / 3, 5) AS r, "
   "round(CAST(embedding[3*k+2] AS DOUBLE), 5) AS g, round(CAST(embedding[3*k+3] AS DOUBLE), 5) AS b FROM (SELECT *, CAST(unnest(range(8)) AS INTEGER) AS k FROM embeddings)")
def _(lib):
    line = "concat_ws(' ', format_string('%.9f', cast(embedding[3*k] AS double)), format_string('%.9f', cast(embedding[3*k+1] AS double)), format_string('%.9f', cast(embedding[3*k+2] AS double)))"
    text = lib.raw("embeddings").selectExpr(
        "vec_id",
        "concat('# look\\nTITLE \"x\"\\nLUT_3D_SIZE 2\\nDOMAIN_MIN -1 0 0\\nDOMAIN_MAX 2 1 1\\n\\n', array_join(transform(sequence(0, 7), k -> "
        + line + "), '\\n')) AS value",
    )
    folder = scratch_dir(lib.spark, "luts")
    text.write.partitionBy("vec_id").text(folder)
    entries = luts.read_luts(lib.spark, folder)[0]
    return entries.select(
        F.regexp_extract("lut_id", r"vec_id=(\d+)", 1).cast("bigint").alias("vec_id"), "size", "ri", "gi", "bi",
        *[rounded(F.col(c), 5).alias(c) for c in "rgb"],
    )


_CSV = (
    "SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice) / 1000e0 END AS latency_ms, round(o_custkey / 7e0, 4) AS cpu_sum_ms, "
    "CASE WHEN o_custkey % 3 = 0 THEN o_custkey / 8e0 END AS gpu_transfer_ms FROM orders"
)


@q("s4_frame_csv", "", _CSV)
def _(lib):
    rows = lib.raw("orders").selectExpr(
        "o_orderkey AS frame", "CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice) / 1000e0 END AS latency_ms",
        "round(o_custkey / 7e0, 4) AS cpu_sum_ms", "CASE WHEN o_custkey % 3 = 0 THEN o_custkey / 8e0 END AS gpu_transfer_ms",
    )
    missing = [c for c in frames.FRAME_COLUMNS if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in missing})
    folder = scratch_dir(lib.spark, "frames")
    frames.write_frame_csv(rows, folder)
    ok, _ = frames.read_frame_csv(lib.spark, folder)
    return ok.select("frame", "latency_ms", "cpu_sum_ms", "gpu_transfer_ms")


@q("s5_catalog_media", "sources",
   "SELECT path, min(seq) AS seq, CASE WHEN e IN ('mp3','wav','aac','flac','ogg','m4a') THEN 'Audio' WHEN e IN ('png','jpg','jpeg','bmp','webp','tiff') THEN 'Image' ELSE 'Video' END AS kind, "
   "e IN ('png','jpg','jpeg','bmp','tiff','tif','webp') AS is_still FROM (SELECT path, source_id AS seq, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS e FROM sources "
   "UNION ALL SELECT lower(path), source_id + 5000, lower(regexp_extract(path, '\\.([^./]*)$', 1)) FROM sources) GROUP BY path, e")
def _(lib):
    listing = lib.sources.selectExpr("path", "source_id AS seq").unionByName(
        lib.sources.selectExpr("lower(path) AS path", "source_id + 5000 AS seq")
    )
    return frames.catalog_media(listing).select("path", "seq", "kind", "is_still")


@q("s6_packet_parquet", "packets",
   "SELECT source_id, count(*) AS packets, CAST(sum(is_key) AS BIGINT) AS sync_packets, max(pts) AS last_pts FROM packets GROUP BY 1")
def _(lib):
    folder = scratch_dir(lib.spark, "packets")
    frames.write_packets(lib.packets, folder)
    return frames.read_packets(lib.spark, folder).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("is_key").alias("sync_packets"), F.max("pts").alias("last_pts")
    )


@q("s7_snapshot_sink", "",
   "SELECT concat('/p/', CAST(user_id AS VARCHAR)) AS path, max(ts) AS version_ts, arg_max(props, ts) AS json FROM events GROUP BY 1")
def _(lib):
    stream = (
        lib.spark.readStream.schema(lib.raw("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(lib.sf_dir)
        .selectExpr("concat('/p/', user_id) AS path", "ts AS version_ts", "props AS json")
    )
    target = scratch_dir(lib.spark, "snapshots")
    snapshots.snapshot_sink(stream, target, f"{target}-log").trigger(availableNow=True).start().awaitTermination()
    return snapshots.read_snapshots(lib.spark, target)


@q("s8_recovery_candidates", "",
   "SELECT s.path, s.version_ts FROM (SELECT user_id AS path, max(ts) AS version_ts FROM events GROUP BY 1) s LEFT JOIN "
   "(SELECT user_id AS path, max(ts) AS saved_ts FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1) v USING (path) WHERE saved_ts IS NULL OR version_ts > saved_ts")
def _(lib):
    e = lib.raw("events")
    snaps = e.groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("version_ts"))
    saved = e.where("event_type = 'purchase' AND value > 60").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("saved_ts"))
    return snapshots.recovery_candidates(snaps, saved).select("path", "version_ts")


_SEQ = (
    "fl AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS n, CAST(greatest(length(CAST(l_partkey AS VARCHAR)), 5) AS INTEGER) AS pad FROM lineitem), "
    "hd AS (SELECT *, lag(n) OVER (PARTITION BY d, pad ORDER BY n) AS before FROM fl), "
    "il AS (SELECT *, sum(CASE WHEN before IS NULL OR n > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY d, pad ORDER BY n) AS island FROM hd)"
)


@q("n1_image_sequences", "",
   "SELECT concat('/render/', CAST(d AS VARCHAR), '/') AS folder, 'shot2_' AS prefix, pad, 'exr' AS ext, concat('shot2_{:0', CAST(pad AS VARCHAR), '}..exr') AS pattern, min(n) AS first_frame, max(n) AS last_frame, coalesce(min(CASE WHEN n > before + 1 THEN n - before - 1 END), 0) AS missing_before FROM il GROUP BY d, pad, island", _SEQ)
def _(lib):
    li = lib.raw("lineitem")
    # Five digits at least; lpad alone would cut longer numbers down.
    number = "lpad(cast(l_partkey AS string), greatest(length(cast(l_partkey AS string)), 5), '0')"
    numbered = li.selectExpr(f"concat('/render/', l_suppkey, '/shot2_', {number}, '.exr') AS path")
    others = li.selectExpr("concat('/render/', l_suppkey, '/notes_', l_partkey, 'a.txt') AS path")
    return textjobs.image_sequences(numbered.unionByName(others))


@q("n2_soa_round_trip", "strip",
   "SELECT project_id, count(*) AS clips, CAST(sum(pts_out - pts_in) AS BIGINT) AS ticks, CAST(count(DISTINCT clip_id) AS BIGINT) AS ids FROM strip GROUP BY 1")
def _(lib):
    clips = round_trip(lib)["clips"]
    return clips.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("clips"), F.sum(F.expr("pts_out - pts_in")).alias("ticks"), F.countDistinct("clip_id").alias("ids")
    )


@q("n3_project_index", "", "SELECT concat('/p/', CAST(c_custkey AS VARCHAR)) AS path, CASE WHEN c_custkey % 6 <> 5 THEN c_name END AS name FROM customer")
def _(lib):
    files = lib.raw("customer").selectExpr(
        "concat('/p/', c_custkey) AS path",
        "CASE c_custkey % 6 WHEN 5 THEN concat('{\"name\": \"', c_name) ELSE concat('{\"format_version\":1,\"clips\":{\"ids\":[1,2]},\"name\":\"', c_name, '\"}') END AS value",
    )
    return textjobs.project_index(files)


@q("n4_interleave", "",
   "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN i % 2 = 0 THEN embedding[i // 2 + 1] ELSE embedding[64 - i // 2] END AS DOUBLE) AS value FROM (SELECT *, unnest(range(128)) AS i FROM embeddings)")
def _(lib):
    chunks = lib.raw("embeddings").select("vec_id", F.col("embedding").alias("left"), F.reverse("embedding").alias("right"))
    out = textjobs.interleave(chunks).select("vec_id", F.posexplode("interleaved").alias("pos", "value"))
    return out.withColumn("value", F.col("value").cast("double"))


@q("n4_deinterleave", "",
   "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[2 * i + 1] AS DOUBLE) AS l, CAST(embedding[2 * i + 2] AS DOUBLE) AS r FROM (SELECT *, unnest(range(32)) AS i FROM embeddings)")
def _(lib):
    chunks = textjobs.deinterleave(lib.raw("embeddings").withColumnRenamed("embedding", "interleaved"))
    out = chunks.select("vec_id", F.posexplode(F.arrays_zip("channel_0", "channel_1")).alias("pos", "v"))
    return out.select("vec_id", "pos", F.col("v.channel_0").cast("double").alias("l"), F.col("v.channel_1").cast("double").alias("r"))


@q("n4_strip_padding", "",
   "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(range(vec_id % 64 + 1)) AS i FROM embeddings)")
def _(lib):
    rows = lib.raw("embeddings").selectExpr("vec_id", "embedding AS data", "cast(vec_id % 64 + 1 AS int) AS row_len")
    out = textjobs.strip_padding(rows).select("vec_id", F.posexplode("data").alias("pos", "value"))
    return out.withColumn("value", F.col("value").cast("double"))


def _fx(i: int, default: str, ok: str = "true") -> str:
    return f"CASE WHEN isfinite(p[{i + 1}]) AND {ok.format(v=f'p[{i + 1}]')} THEN p[{i + 1}] ELSE {default} END"


_POS = "{v} > 0"
_FX_COLS = {
    "ColorCorrection": {
        **{f"lift_{c}": f"p[{i + 1}]" for i, c in enumerate("rgb")},
        **{f"gamma_{c}": _fx(4 + i, "1", _POS) for i, c in enumerate("rgb")},
        **{f"gain_{c}": f"p[{9 + i}]" for i, c in enumerate("rgb")},
        "saturation": _fx(12, "1"), "brightness": _fx(13, "0"), "contrast": _fx(14, "1", "{v} >= 0"), "hue_shift": _fx(15, "0"),
    },
    "GaussianBlur": {
        "blur_radius": _fx(0, "10", _POS), "blur_sigma": _fx(1, f"({_fx(0, '10', _POS)}) * 0.5e0", _POS),
    },
    "Sharpen": {"sharpen_amount": _fx(0, "0.5")},
    "Vignette": {
        "vignette_intensity": _fx(0, "0.5"), "vignette_radius": _fx(1, "0.75", _POS), "vignette_softness": _fx(2, "0.45", _POS),
        "vignette_roundness": _fx(3, "1"), "vignette_center_x": _fx(4, "0.5"), "vignette_center_y": _fx(5, "0.5"),
    },
    "ChromaKey": {
        c: f"CASE WHEN p[2] > 0 AND p[3] < p[2] THEN p[{i + 1}] ELSE {d} END"
        for i, (c, d) in enumerate(textjobs.GREEN_KEY.items())
    },
}
_FX_LIST = [c for cols in _FX_COLS.values() for c in cols]
_FX_SQL = ", ".join(
    f"CASE WHEN kind = '{k}' THEN round({e}, 6) END AS {c}" for k, cols in _FX_COLS.items() for c, e in cols.items()
)


@q("n5_decode_effects", "", f"SELECT clip_id, position, kind, {_FX_SQL} FROM fx",
   "fx AS (SELECT vec_id AS clip_id, CAST(vec_id % 4 AS INTEGER) AS position, CASE vec_id % 6 WHEN 0 THEN 'ColorCorrection' WHEN 1 THEN 'GaussianBlur' WHEN 2 THEN 'Sharpen' WHEN 3 THEN 'Vignette' WHEN 4 THEN 'ChromaKey' ELSE 'Transform2D' END AS kind, "
   "list_transform(range(16), lambda i: CASE WHEN vec_id % 7 = 3 AND i = label % 3 THEN 'nan'::DOUBLE ELSE CAST(embedding[i + 1] AS DOUBLE) END) AS p FROM embeddings WHERE label <> 4)")
def _(lib):
    fx = lib.raw("embeddings").selectExpr(
        "vec_id AS clip_id", "cast(vec_id % 4 AS int) AS position",
        "CASE vec_id % 6 WHEN 0 THEN 'ColorCorrection' WHEN 1 THEN 'GaussianBlur' WHEN 2 THEN 'Sharpen' WHEN 3 THEN 'Vignette' WHEN 4 THEN 'ChromaKey' ELSE 'Transform2D' END AS kind",
        "label <> 4 AS enabled",
        "transform(sequence(0, 15), i -> CASE WHEN vec_id % 7 = 3 AND i = label % 3 THEN double('NaN') ELSE cast(embedding[i] AS double) END) AS params",
    )
    out = textjobs.decode_effects(fx)
    return out.select("clip_id", "position", "kind", *[rounded(F.col(c)).alias(c) for c in _FX_LIST])
