"""Project documents: JSON with one array per clip attribute, to and from tables, without loss.

Values with a variable shape (effects, corner pins, stream information, what a tagged kind
holds) are columns of JSON text. Members this module doesn't know are kept too: ``more`` maps
their names to JSON text, for a clip, a source or a track by itself, and for the document and
its sections in ``projects`` ('clips/next_id', '/name of a top-level member').
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1

# Clip arrays of a document -> (column, type, default when absent).
CLIP_ARRAYS: Mapping[str, tuple[str, str, object]] = {
    "ids": ("clip_id", "bigint", None),
    "track_ids": ("track_id", "int", None),
    "source_ids": ("source_id", "bigint", None),
    "pts_in": ("pts_in", "bigint", None),
    "pts_out": ("pts_out", "bigint", None),
    "source_in": ("source_in", "bigint", None),
    "kind": ("kind", "string", "Video"),
    "layer_order": ("layer_order", "int", 0),
    "opacity": ("opacity", "double", 1.0),
    "volume": ("volume", "double", 1.0),
    "pan": ("pan", "double", 0.0),
    "audio_muted": ("audio_muted", "boolean", False),
    "fade_in_pts": ("fade_in_pts", "bigint", 0),
    "fade_out_pts": ("fade_out_pts", "bigint", 0),
    "speed": ("speed", "double", 1.0),
    "pitch": ("pitch", "double", 0.0),
    "blend_mode": ("blend_mode", "string", "Normal"),
    "matte_mode": ("matte_mode", "string", "None"),
    "transform": ("transform", "struct<position:array<double>,scale:array<double>,rotation:double,anchor:array<double>>", None),
    "crop": ("crop", "struct<left:double,top:double,right:double,bottom:double,feather:double>", None),
    "corner_pin": ("corner_pin", "string", None),
    "effects": ("effects", "string", None),
    "effect_start": ("effect_start", "bigint", None),
    "effect_count": ("effect_count", "int", None),
}
# The same of the media pool.
SOURCE_ARRAYS: Mapping[str, tuple[str, str]] = {
    "ids": ("source_id", "bigint"), "paths": ("path", "string"), "proxy_ids": ("proxy_id", "bigint"), "video_info": ("video_info", "string"), "audio_info": ("audio_info", "string"),
}
# Columns of JSON text, as they stand in the document.
JSON_COLUMNS = frozenset({"corner_pin", "effects", "video_info", "audio_info"})
TRACK_FIELDS = ("id", "kind", "name", "mute", "solo", "locked", "gain", "pan")
# Members that have columns of their own, by section.
_KNOWN = {
    "": ("format_version", "project_id", "name", "settings", "tracks", "clips", "sources"),
    "settings": ("width", "height", "frame_rate", "timebase"),
    "tracks": ("tracks",),
    "clips": (*CLIP_ARRAYS, "keyframes"),
    "sources": tuple(SOURCE_ARRAYS),
}

_RATIO = "struct<num:bigint,den:bigint>"
_KEYS = "array<struct<clip_id:bigint,param:string,keys:array<struct<pts:bigint,value:double,interp:string>>>>"
_TRACK = "struct<id:int,kind:string,name:string,mute:boolean,solo:boolean,locked:boolean,gain:double,pan:double>"
_MORE = "map<string,string>"


def _schema() -> str:
    arrays = ",".join(f"{name}:array<{typ}>" for name, (_, typ, _) in CLIP_ARRAYS.items())
    pool = ",".join(f"{name}:array<{typ}>" for name, (_, typ) in SOURCE_ARRAYS.items())
    return (
        "format_version int, project_id bigint, name string,"
        f"settings struct<width:int,height:int,frame_rate:{_RATIO},timebase:{_RATIO}>,"
        f"tracks struct<tracks:array<{_TRACK}>>,"
        f"clips struct<{arrays},keyframes:struct<tracks:{_KEYS}>>,"
        f"sources struct<{pool}>,"
        "_corrupt_record string"
    )


def _variant(kind: Column) -> Column:
    """Name of a tagged value: plain, or the key of a one-field object."""
    return F.when(kind.startswith("{"), F.regexp_extract(kind, r'^\{\s*"(\w+)"', 1)).otherwise(kind)


def _payload(kind: Column) -> Column:
    """JSON text of what a tagged value holds; null for a plain one."""
    return F.when(kind.startswith("{"), F.regexp_extract(kind, r'(?s)^\{\s*"\w+"\s*:\s*(.*?)\s*\}\s*$', 1))


def _unknown(members: Column, section: str) -> Column:
    """The members of an object (name to variant) that have no column of their own."""
    return F.map_filter(members, lambda k, v: ~k.isin(*_KNOWN[section]))


def _as_text(members: Column) -> Column:
    return F.transform_values(members, lambda k, v: F.to_json(v))


def _once(value: Column) -> Column:
    """To be exploded: filters, projections and lambdas above an explode can't repeat what made the value."""
    return F.array(value)


def _list(value: Column) -> Column:
    """The elements of a variant, null if it isn't an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def _element_members(lists: Column, n: Column) -> Column:
    """For each of ``n`` elements the members (name to JSON text) of the lists, a map of names to arrays."""
    at = lambda i: F.transform_values(lists, lambda k, a: F.to_json(F.get(a, i)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at))


def _more(doc: Column, section: str) -> Column:
    """The unknown members of a section that aren't lists with one element per row, named section/member."""
    found = _unknown(F.try_variant_get(doc, f"$.{section}" if section else "$", "map<string,variant>"), section)
    if section in ("clips", "sources"):
        found = F.map_filter(found, lambda k, v: _list(v).isNull())
    named = F.transform_keys(_as_text(found), lambda k, v: F.concat(F.lit(f"{section}/"), k))
    return F.coalesce(named, F.create_map().cast(_MORE))


def read_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``projects, tracks, clips, keyframes, sources, rejects`` of a document folder.

    Unreadable documents and newer format versions are rejected. A document without
    ``project_id`` is keyed by a hash of its path.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(F.length("value") > 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.struct(F.from_json("value", _schema(), options).alias("d"), F.try_parse_json("value").alias("doc"))
    raw = files.select(F.col("_metadata.file_path").alias("path"), F.explode(_once(parsed)).alias("p")).select("p.d.*", "p.doc", "path")
    broken = F.col("_corrupt_record").isNotNull() | F.col("format_version").isNull() | F.col("clips.ids").isNull() | F.col("doc").isNull()
    reason = F.when(broken, "Unreadable").when(F.col("format_version") > FORMAT_VERSION, "NewerFormat")
    raw = raw.withColumn("reason", reason)
    rejects = raw.where(F.col("reason").isNotNull()).select("path", "reason")
    docs = raw.where(F.col("reason").isNull()).withColumns(
        {"project_id": F.coalesce("project_id", F.xxhash64("path"))}
    )

    projects = docs.select(
        "project_id", "name", "path", F.col("settings.width").alias("width"), F.col("settings.height").alias("height"),
        F.col("settings.frame_rate").alias("frame_rate"), F.col("settings.timebase").alias("timebase"),
        F.map_concat(*[_more(F.col("doc"), section) for section in _KNOWN]).alias("more"),
    )
    track_members = F.try_variant_get("doc", "$.tracks.tracks", "array<map<string,variant>>")
    others = F.transform(track_members, lambda m: _as_text(F.map_filter(m, lambda k, v: ~k.isin(*TRACK_FIELDS))))
    tracks = docs.select("project_id", others.alias("more"), F.posexplode("tracks.tracks").alias("position", "t")).select(
        "project_id", F.col("t.id").alias("track_id"), "position", _variant(F.col("t.kind")).alias("kind"),
        *[F.col(f"t.{c}").alias(c) for c in ("name", "mute", "solo", "locked")],
        F.coalesce("t.gain", F.lit(1.0)).alias("gain"), F.coalesce("t.pan", F.lit(0.0)).alias("pan"),
        _payload(F.col("t.kind")).alias("payload"), F.get("more", F.col("position")).alias("more"),
    )
    clips = _rows(docs, "clips", {name: (col, typ) for name, (col, typ, _) in CLIP_ARRAYS.items()}).where(F.col("clip_id").isNotNull())
    clips = clips.select(
        "project_id",
        *[
            _default(_variant(F.col(col)) if col == "kind" else F.col(col), default).alias(col)
            for col, _, default in CLIP_ARRAYS.values()
        ],
        _payload(F.col("kind")).alias("payload"), "more",
    )
    keyframes = docs.select("project_id", F.explode("clips.keyframes.tracks").alias("t")).select(
        "project_id", F.col("t.clip_id").alias("clip_id"), F.col("t.param").alias("param"), F.inline("t.keys")
    )
    src = _rows(docs, "sources", SOURCE_ARRAYS).where(F.col("source_id").isNotNull())
    return {
        "projects": projects, "tracks": tracks, "clips": clips, "keyframes": keyframes, "sources": src, "rejects": rejects,
    }


def _rows(docs: DataFrame, section: str, arrays: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per element of the parallel lists of a section; absent ones give nulls."""
    lists = [F.coalesce(F.col(f"{section}.{name}"), F.array().cast(f"array<{typ}>")).alias(col) for name, (col, typ) in arrays.items()]
    members = _unknown(F.try_variant_get("doc", f"$.{section}", "map<string,variant>"), section)
    unknown = F.map_filter(F.transform_values(members, lambda k, v: _list(v)), lambda k, a: a.isNotNull())
    docs = docs.select("project_id", section, F.explode(_once(unknown)).alias("unknown"))
    more = F.coalesce(_element_members(F.col("unknown"), F.size(f"{section}.ids")), F.array().cast(f"array<{_MORE}>"))
    zipped = docs.select("project_id", *lists, more.alias("more"))
    return zipped.select("project_id", F.inline(F.arrays_zip(*[c for c in zipped.columns if c != "project_id"])))


def _default(value: Column, default: object) -> Column:
    return value if default is None else F.coalesce(value, F.lit(default))


def _joined(items: Column) -> Column:
    """JSON array of an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit("null"))), ","), F.lit("]"))


def _object(members: Mapping[str, Column], more: Column | None = None) -> Column:
    """JSON object of JSON texts; ``more`` maps further names to such."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))) for name, value in members.items()]
    listed = F.array(*parts)
    if more is not None:
        entry = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])
        listed = F.concat(listed, F.coalesce(F.transform(F.map_entries(more), entry), F.array().cast("array<string>")))
    return F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def _tagged(kind: Column, payload: Column) -> Column:
    return F.when(payload.isNull(), _quoted(kind)).otherwise(F.concat(F.lit("{"), _quoted(kind), F.lit(":"), payload, F.lit("}")))


def _text(value: Column) -> Column:
    """JSON text of any value, null for null."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _lists(rows: str, columns: Mapping[str, str], has_more: bool) -> tuple[dict[str, Column], Column | None]:
    """The parallel lists of an array of rows: known ones by name, unknown ones as a map of JSON texts."""
    rows = F.coalesce(F.col(rows), F.array())

    def listed(column: str) -> Column:
        if column == "kind":
            return _joined(rows["kind_text"])
        return _joined(rows[column]) if column in JSON_COLUMNS else F.to_json(rows[column], {"ignoreNullFields": "false"})

    known = {name: listed(column) for name, column in columns.items()}
    if not has_more:
        return known, None
    names = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.coalesce(F.map_keys(r["more"]), F.array().cast("array<string>")))))
    lists = F.transform(names, lambda k: F.struct(k.alias("key"), _joined(F.transform(rows, lambda r: F.get(F.transform(F.array(r["more"]), lambda m: m[k]), F.lit(0)))).alias("value")))
    return known, F.map_from_entries(lists)


def _of_section(more: Column, section: str) -> Column:
    start = f"{section}/"
    found = F.map_filter(more, lambda k, v: k.startswith(start))
    return F.transform_keys(found, lambda k, v: F.substring(k, F.lit(len(start) + 1), F.length(k)))


def write_projects(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """One document per row of ``projects``, from the tables ``read_projects`` gives; what can't be written.

    A document is one JSON value, so a project's rows meet in one task here and nowhere
    else; projects without clips, keys, tracks or sources have empty lists. Rows of a project
    that ``projects`` lacks belong to no document: the result counts them by project and
    table (``part``). Columns the documents have no place for are not written.
    """
    clips, sources, heads = tables["clips"], tables["sources"], tables["projects"]
    order = ["pts_in", "clip_id"]
    present = {n: c for n, (c, _, _) in CLIP_ARRAYS.items() if c in clips.columns}
    payload = lambda df: F.col("payload") if "payload" in df.columns else F.lit(None).cast("string")
    more = lambda df: [F.col("more")] if "more" in df.columns else []
    if "kind" in clips.columns:
        clips = clips.withColumn("kind_text", _tagged(F.col("kind"), payload(clips)))
    # Maps can't be ordered, so the sort takes a number that stands for the place alone.
    fields = F.struct(*order, *[c for c in present.values() if c not in (*order, "kind")], *(["kind_text"] if "kind" in clips.columns else []), *more(clips))
    by = lambda a, b: F.when(a[order[0]] != b[order[0]], F.signum(a[order[0]] - b[order[0]])).otherwise(F.signum(a[order[1]] - b[order[1]])).cast("int")
    clip_docs = clips.groupBy("project_id").agg(F.array_sort(F.collect_list(fields), by).alias("c"))

    if "keyframes" in tables:
        key = F.struct("pts", "value", "interp")
        tracks = tables["keyframes"].groupBy("project_id", "clip_id", "param").agg(F.array_sort(F.collect_list(key)).alias("keys"))
        key_docs = tracks.groupBy("project_id").agg(
            F.array_sort(F.collect_list(F.struct("clip_id", "param", "keys"))).alias("k")
        )
    else:
        key_docs = clip_docs.select("project_id", F.lit(None).cast(_KEYS).alias("k"))

    known_more = F.col("more") if "more" in heads.columns else F.create_map().cast(_MORE)
    head = heads.select("project_id", "name", F.struct("width", "height", "frame_rate", "timebase").alias("settings"), known_more.alias("more"))
    # Tracks are at most 255 a project; the media pool is a library, not the edit.
    held = tables["tracks"]
    track = _object(
        {"id": _text(F.col("track_id")), "kind": _tagged(F.col("kind"), payload(held)), **{c: _text(F.col(c)) for c in ("name", "mute", "solo", "locked", "gain", "pan")}},
        *more(held),
    )
    track_docs = held.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("position", track.alias("text")))).alias("t"))
    pool = {n: c for n, (c, _) in SOURCE_ARRAYS.items() if c in sources.columns}
    listed = F.struct(*pool.values(), *more(sources))
    by_id = lambda a, b: F.signum(a["source_id"] - b["source_id"]).cast("int")
    source_docs = sources.groupBy("project_id").agg(F.array_sort(F.collect_list(listed), by_id).alias("s"))
    full = head.join(clip_docs, "project_id", "left").join(key_docs, "project_id", "left").join(track_docs, "project_id", "left").join(source_docs, "project_id", "left")

    # Counted apart, so that no document is put together for its size.
    ids = heads.select("project_id")
    lost = [
        tables[part].groupBy("project_id").agg(F.count(F.lit(1)).alias("rows")).join(ids, "project_id", "left_anti")
        .select("project_id", F.lit(part).alias("part"), "rows", F.lit("NoProject").alias("reason"))
        for part in ("clips", "tracks", "sources", "keyframes") if part in tables
    ]
    orphans = reduce(DataFrame.unionByName, lost)

    clip_lists, other_clips = _lists("c", present, bool(more(clips)))
    source_lists, other_sources = _lists("s", pool, bool(more(sources)))
    merged = lambda section, other: _of_section(F.col("more"), section) if other is None else F.map_concat(_of_section(F.col("more"), section), other)
    keys = F.to_json(F.struct(F.coalesce("k", F.array()).alias("tracks")), {"ignoreNullFields": "false"})
    settings = {c: _text(F.col(f"settings.{c}")) for c in ("width", "height", "frame_rate", "timebase")}
    body = _object(
        {
            "format_version": F.lit(str(FORMAT_VERSION)), "project_id": _text(F.col("project_id")), "name": _text(F.col("name")),
            "settings": _object(settings, _of_section(F.col("more"), "settings")),
            "tracks": _object({"tracks": _joined(F.coalesce(F.transform("t", lambda r: r["text"]), F.array().cast("array<string>")))}, _of_section(F.col("more"), "tracks")),
            "clips": _object({**clip_lists, "keyframes": keys}, merged("clips", other_clips)),
            "sources": _object(source_lists, merged("sources", other_sources)),
        },
        _of_section(F.col("more"), ""),
    )
    full.select(body.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return orphans
