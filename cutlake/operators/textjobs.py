"""String, array and JSON jobs: image sequences, name index, interleaving, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators.scan import Scan, chunked_scan


# Folder, prefix, last digits and extension of a numbered file; everything up to the last slash is the folder.
_NUMBERED = r"^((?:[^/]*/)*+)(.*?)([0-9]+)\.([^.]*)$"
_MARK = "\0"


def parse_sequence_names(listing: DataFrame) -> DataFrame:
    """Numbered picture files: folder, prefix, digits, extension and the pattern string.

    A path is matched once: its parts leave the explode as one array, past which no filter or
    projection can repeat the match.
    """
    parts = F.split(F.regexp_replace("path", _NUMBERED, _MARK.join(("$1", "$2", "$3", "$4"))), _MARK)
    found = listing.select("*", F.explode_outer(F.array(parts)).alias("__parts")).where(F.size("__parts") == 4)
    part = lambda i: F.get("__parts", F.lit(i))
    named = found.select(
        *listing.columns, part(0).alias("folder"), part(3).alias("ext"), part(1).alias("prefix"), F.length(part(2)).alias("pad"),
        part(2).try_cast("bigint").alias("frame"),
    ).where(F.col("frame").isNotNull())
    return named.withColumn("pattern", _pattern())


def _pattern() -> Column:
    return F.concat("prefix", F.lit("{:0"), F.col("pad").cast("string"), F.lit("}.."), "ext")


def image_sequences(listing: DataFrame) -> DataFrame:
    """Runs of consecutive frame numbers per sequence, with the frames missing before each.

    One scan finds the frames at which a run starts or ends; a second one, over these few,
    gives each start its end.
    """
    key = ["folder", "prefix", "pad", "ext"]
    frames = parse_sequence_names(listing).select(*key, "frame").distinct()
    near = [Scan("before", "last", F.col("frame"), inclusive=False), Scan("after", "first", F.col("frame"), inclusive=False)]
    seen = chunked_scan(frames, key, "frame", near)
    starts = F.col("before").isNull() | (F.col("frame") > F.col("before") + 1)
    ends = F.col("after").isNull() | (F.col("after") > F.col("frame") + 1)
    edges = seen.select(*key, "frame", "before", starts.alias("starts"), ends.alias("ends")).where("starts or ends")
    edges = chunked_scan(edges, key, "frame", [Scan("next", "first", F.col("frame"), inclusive=False)])
    return edges.where("starts").select(
        *key,
        _pattern().alias("pattern"),
        F.col("frame").alias("first_frame"),
        F.when(F.col("ends"), F.col("frame")).otherwise(F.col("next")).alias("last_frame"),
        F.coalesce(F.col("frame") - F.col("before") - 1, F.lit(0)).alias("missing_before"),
    )


def project_index(files: DataFrame) -> DataFrame:
    """Project name of each JSON document, read without parsing the rest."""
    return files.select("path", F.get_json_object("value", "$.name").alias("name"))


def interleave(chunks: DataFrame) -> DataFrame:
    """L, R, L, R ... from planar chunk arrays ``left`` and ``right``."""
    pairs = F.zip_with("left", "right", lambda a, b: F.array(a, b))
    return chunks.withColumn("interleaved", F.flatten(pairs))


def deinterleave(chunks: DataFrame, channels: int = 2) -> DataFrame:
    """Planar arrays ``channel_0..`` from ``interleaved``."""

    def plane(ch: int) -> Column:
        return F.filter("interleaved", lambda _, i: i % channels == ch)

    return chunks.withColumns({f"channel_{c}": plane(c) for c in range(channels)})


def strip_padding(lines: DataFrame) -> DataFrame:
    """Row arrays cut to their first ``row_len`` elements."""
    return lines.withColumn("data", F.slice("data", F.lit(1), F.col("row_len")))


def _slot(i: int, default: float, ok=None) -> Column:
    """Parameter slot i if present, finite and acceptable, else the default."""
    v = F.try_element_at("params", F.lit(i + 1)).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if ok is not None:
        good = good & ok(v)
    return F.when(good, v).otherwise(F.lit(float(default)))


def _raw(i: int) -> Column:
    return F.try_element_at("params", F.lit(i + 1)).cast("double")


def _positive(v: Column) -> Column:
    return v > 0


# The green-screen key used when a chroma key's own values are unusable.
GREEN_KEY = {
    "key_hue": 120.0, "key_tolerance": 40.0, "key_softness": 10.0,
    "key_min_saturation": 0.15, "key_min_value": 0.08, "key_spill_suppress": 0.3,
}


def decode_effects(clip_effects: DataFrame) -> DataFrame:
    """Named parameters of each clip's effects, with the defaults for unusable values.

    One row per (project, clip) and list position; columns of other kinds are NULL.
    """
    kind = F.col("kind")

    def only(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    radius = _slot(0, 10.0, _positive)
    out = {}
    for axis, i in (("r", 0), ("g", 1), ("b", 2)):
        out[f"lift_{axis}"] = only("ColorCorrection", _raw(i))
        out[f"gamma_{axis}"] = only("ColorCorrection", _slot(4 + i, 1.0, _positive))
        out[f"gain_{axis}"] = only("ColorCorrection", _raw(8 + i))
    out["saturation"] = only("ColorCorrection", _slot(12, 1.0))
    out["brightness"] = only("ColorCorrection", _slot(13, 0.0))
    out["contrast"] = only("ColorCorrection", _slot(14, 1.0, lambda v: v >= 0))
    out["hue_shift"] = only("ColorCorrection", _slot(15, 0.0))
    out["blur_radius"] = only("GaussianBlur", radius)
    sigma = _raw(1)
    usable = sigma.isNotNull() & ~F.isnan(sigma) & (F.abs(sigma) != float("inf")) & (sigma > 0)
    out["blur_sigma"] = only("GaussianBlur", F.when(usable, sigma).otherwise(radius * 0.5))
    out["sharpen_amount"] = only("Sharpen", _slot(0, 0.5))
    for i, (name, default, ok) in enumerate(
        (
            ("intensity", 0.5, None), ("radius", 0.75, _positive), ("softness", 0.45, _positive),
            ("roundness", 1.0, None), ("center_x", 0.5, None), ("center_y", 0.5, None),
        )
    ):
        out[f"vignette_{name}"] = only("Vignette", _slot(i, default, ok))
    valid = (_raw(1) > 0) & (_raw(2) < _raw(1))
    for i, (name, default) in enumerate(GREEN_KEY.items()):
        value = F.when(F.coalesce(valid, F.lit(False)), _raw(i)).otherwise(F.lit(default))
        out[name] = only("ChromaKey", value)
    return clip_effects.where("enabled").withColumns(out).drop("params", "enabled")

