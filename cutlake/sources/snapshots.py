"""Autosave snapshots: a newest-wins table and the recovery report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BUCKETS = 32


def newest(snapshots: DataFrame) -> DataFrame:
    """The newest ``(path, version_ts, json)`` per path."""
    rest = [c for c in snapshots.columns if c != "path"]
    best = snapshots.groupBy("path").agg(F.max_by(F.struct(*rest), "version_ts").alias("s"))
    return best.select("path", *[F.col(f"s.{c}").alias(c) for c in rest])


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


def upsert_snapshots(batch: DataFrame, target: str, batch_id: int) -> None:
    """Merge one batch into the table at ``target``; an older snapshot never wins.

    Only the path buckets the batch touches are written, each whole, as a new
    generation. It becomes visible when its success marker appears, so readers never
    see half a write; replaying a batch rewrites the same generation.
    """
    spark = batch.sparkSession
    new = _bucketed(newest(batch))
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most BUCKETS rows
    now = [p for b, p in bucket_folders(spark, target, before=batch_id).items() if b in touched]
    if now:
        new = _bucketed(newest(spark.read.parquet(*now).unionByName(new.drop("bucket"))))
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/gen={batch_id:012d}")


def bucket_folders(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Per bucket, its folder in the newest complete generation that has it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def children(folder: str, prefix: str) -> dict[int, str]:
        if not fs.exists(path(folder)):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(prefix)}

    found: dict[int, str] = {}
    for gen, folder in sorted(children(target, "gen=").items()):
        if (before is None or gen < before) and fs.exists(path(f"{folder}/_SUCCESS")):
            found.update(children(folder, "bucket="))
    return found


def snapshot_sink(stream: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Streaming writer that keeps only the newest snapshot of each path."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: upsert_snapshots(batch, target, batch_id)
    )


def read_snapshots(spark: SparkSession, target: str) -> DataFrame:
    """The newest snapshot of every path."""
    return spark.read.parquet(*bucket_folders(spark, target).values())


def recovery_candidates(snapshots: DataFrame, saved: DataFrame) -> DataFrame:
    """Snapshots newer than the saved project, or without one."""
    known = saved.select("path", F.col("saved_ts"))
    out = snapshots.join(known, "path", "left")
    return out.where(F.col("saved_ts").isNull() | (F.col("version_ts") > F.col("saved_ts")))
