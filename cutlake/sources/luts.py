"""3D lookup tables from ``.cube`` text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions.arith import idiv

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def _words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")


def _numeric(words: Column) -> Column:
    return F.forall(words, lambda w: w.rlike(_NUMBER))


def read_luts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """LUT entries ``(lut_id, size, ri, gi, bi, r, g, b)`` and the rejected files.

    A file is one row, so files are spread over tasks; data lines keep their order
    (red fastest). A domain other than 0..1 normalises the stored values. Rejects:
    InvalidHeader or ParseError (whichever comes first), MissingSize,
    DataCountMismatch.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("lut_id"), "value")
    lines = F.transform(F.split("value", r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    files = files.select("lut_id", lines.alias("lines"))

    def kind(s: Column) -> Column:
        return (
            F.when((s == "") | s.startswith("#"), "skip")
            .when(s.startswith("LUT_3D_SIZE"), "size")
            .when(s.startswith("DOMAIN_MIN"), "min")
            .when(s.startswith("DOMAIN_MAX"), "max")
            .when(s.rlike(r"^[0-9+-]"), "data")
            .otherwise("skip")
        )

    def check(s: Column) -> Column:
        k, data, rest = kind(s), _words(s), _words(s.substr(F.lit(11), F.length(s)))
        size_ok = F.trim(s.substr(F.lit(12), F.length(s))).rlike(r"^\+?[0-9]{1,9}$")
        triple_ok = _numeric(rest) & (F.size(rest) >= 3)
        return (
            F.when((k == "size") & ~size_ok, "InvalidHeader")
            .when(k.isin("min", "max") & ~triple_ok, "InvalidHeader")
            .when((k == "data") & ~(_numeric(data) & (F.size(data) == 3)), "ParseError")
        )

    def last(name: str, at: int) -> Column:
        found = F.filter("lines", lambda s: kind(s) == name)
        line = F.try_element_at(found, F.lit(-1))
        return line.substr(F.lit(at), F.length(line))

    staged = files.withColumns(
        {
            "fault": F.try_element_at(
                F.filter(F.transform("lines", check), lambda e: e.isNotNull()), F.lit(1)
            ),
            "size": F.regexp_replace(F.trim(last("size", 12)), r"^\+", "").try_cast("bigint"),
            "lo": F.transform(_words(last("min", 11)), lambda w: w.try_cast("double")),
            "hi": F.transform(_words(last("max", 11)), lambda w: w.try_cast("double")),
            "data": F.filter("lines", lambda s: kind(s) == "data"),
        }
    ).drop("lines")
    n = F.col("size")
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(n.isNull(), "MissingSize")
        .when(F.size("data") != n * n * n, "DataCountMismatch")
    )
    judged = staged.withColumn("reason", reason)
    rejects = judged.where(F.col("reason").isNotNull()).select("lut_id", "reason")

    entries = judged.where(F.col("reason").isNull()).select(
        "lut_id", "size", "lo", "hi", F.posexplode("data").alias("k", "line")
    )
    k = F.col("k").cast("bigint")
    words = _words(F.col("line"))

    def channel(i: int) -> Column:
        v = F.get(words, F.lit(i)).cast("double")
        lo = F.coalesce(F.get("lo", F.lit(i)), F.lit(0.0))
        hi = F.coalesce(F.get("hi", F.lit(i)), F.lit(1.0))
        return F.when(F.abs(hi - lo) > 1e-6, (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(v)

    luts = entries.select(
        "lut_id",
        "size",
        (k % n).cast("int").alias("ri"),
        (idiv(k, n) % n).cast("int").alias("gi"),
        idiv(k, n * n).cast("int").alias("bi"),
        *[channel(i).alias(c) for i, c in enumerate("rgb")],
    )
    return luts, rejects
