"""Per-frame timing CSV, packet tables, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the frame timing file, in order.
FRAME_COLUMNS = (
    "latency_ms", "cpu_sum_ms", "decode_ms", "upload_ms", "upload_prepare_ms", "upload_submit_ms",
    "composite_ms", "gpu_submit_ms", "gpu_wait_ms", "nvenc_ms", "gpu_graph_ms", "gpu_transfer_ms",
)
FRAME_SCHEMA = T.StructType(
    [T.StructField("frame", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in FRAME_COLUMNS]]
)


def read_frame_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frame rows, and the lines whose field count or numbers do not fit.

    An empty field is NULL: not measured, never zero. Every field is a number or
    empty, so lines are split here and judged whole, whatever columns are read later.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("frame,") & (F.trim("value") != ""))
    fields = F.split("value", ",", -1)
    names = FRAME_SCHEMA.fieldNames()
    numeric = F.forall(fields, lambda f: (f == "") | f.try_cast("double").isNotNull())
    fits = (F.size(fields) == len(names)) & numeric & F.get(fields, F.lit(0)).try_cast("bigint").isNotNull()
    good = lines.where(fits).select(fields.alias("f"))
    ok = good.select(
        *[
            F.when(F.col("f")[i] != "", F.col("f")[i].try_cast(t.dataType)).alias(t.name)
            for i, t in enumerate(FRAME_SCHEMA.fields)
        ]
    )
    return ok, lines.where(~fits).select(F.col("value").alias("line"))


def write_frame_csv(frames: DataFrame, path: str) -> None:
    """Frame rows with four decimals, NULL as an empty field."""
    cols = [F.format_string("%.4f", c).alias(c) for c in FRAME_COLUMNS]
    cols = [F.when(F.col(n).isNotNull(), c).alias(n) for n, c in zip(FRAME_COLUMNS, cols)]
    frames.select("frame", *cols).write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


PACKET_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("pts", T.LongType()),
        T.StructField("is_key", T.IntegerType()),
    ]
)


def write_packets(packets: DataFrame, path: str, buckets: int = 16) -> None:
    """Packet table as Parquet in source buckets, sorted for row-group skipping."""
    cells = packets.withColumn("bucket", F.pmod(F.hash("source_id"), F.lit(buckets)))
    cells.repartition("bucket", "source_id").sortWithinPartitions("bucket", "source_id", "pts").write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(path)


def read_packets(spark: SparkSession, path: str, source_id: int | None = None, buckets: int = 16) -> DataFrame:
    """Packets, of one source if asked: its bucket alone is listed and read."""
    df = spark.read.parquet(path)
    if source_id is not None:
        bucket = F.pmod(F.hash(F.lit(source_id).cast("bigint")), F.lit(buckets))
        df = df.where((F.col("bucket") == bucket) & (F.col("source_id") == source_id))
    return df.drop("bucket")


# File extensions by medium.
VIDEO_EXT = ("mp4", "mov", "mkv", "avi", "webm", "mxf", "m4v")
AUDIO_EXT = ("mp3", "wav", "aac", "flac", "ogg", "m4a")
IMAGE_EXT = ("png", "jpg", "jpeg", "bmp", "webp", "tiff")
STILL_EXT = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with size and time; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def catalog_media(listing: DataFrame) -> DataFrame:
    """Files by medium with the still-image flag; the first listing of a path stays.

    ``listing(path, seq)``. Unknown extensions count as video.
    """
    ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]*)$", 1))
    kind = F.when(ext.isin(*AUDIO_EXT), "Audio").when(ext.isin(*IMAGE_EXT), "Image").otherwise("Video")
    first = listing.groupBy("path").agg(F.min("seq").alias("seq"))
    return first.withColumns(
        {
            "name": F.element_at(F.split("path", "/"), -1),
            "kind": kind,
            "is_still": ext.isin(*STILL_EXT),
        }
    )
