"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; cluster sizing stays with whoever starts the session.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive skew handling the joins count on; pin UTC; ship the package.

    The settings hold for the whole given session.
    """
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per application.

    Workers then find it from whatever folder they start. A package that already comes
    from an archive has been sent by whoever started the application.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the cluster's shared scratch location.

    The location is whatever ``spark.checkpoint.dir`` names. Only a session whose one
    process is this one, and which names none, falls back to a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and go on from the files.

    Used where a result feeds several branches of a deep plan, or a round of a loop. It keeps
    planning linear, and a lost executor costs a re-read instead of a recomputation. Files,
    rather than ``checkpoint()``: that computes its input twice, and keeps the size estimate of
    the plan it replaces, which every join of every round multiplies.
    """
    path = scratch_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
