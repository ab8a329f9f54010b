"""What the operators of this package share: table reads, tokenizer files, staged tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.session import scratch_dir

T = TypeVar("T")
Plan = Callable[[SparkSession, str], DataFrame]

# Tokenizer files are vocabularies: a few MB, whatever the size of the corpus.
TOKENIZER_FILE_LIMIT = 64 << 20

# The white space and the words all operators on words share.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return table.select(*columns) if columns else table


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write ``df`` as Parquet; its shuffle files go once the files stand, as nobody runs it again."""
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, "false")
    conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(_DROP_SHUFFLES, before)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and go on from the files.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_dir(df.sparkSession, f"{purpose}-{uuid.uuid4().hex[:8]}")
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file, read on the driver and sent once to each executor."""
    with open(path, "rb") as file:
        data = file.read(TOKENIZER_FILE_LIMIT + 1)
    if len(data) > TOKENIZER_FILE_LIMIT:
        raise ValueError(f"{path} is larger than {TOKENIZER_FILE_LIMIT} bytes")
    return spark.sparkContext.broadcast(data)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batches: Iterable[pa.RecordBatch], column: str, target: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``target`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > target:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def text_groups(batches: Iterable[pa.RecordBatch], column: str, target: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """``text_slices``, each with its texts."""
    for batch in text_slices(batches, column, target):
        yield batch, batch.column(column).to_pylist()


class Memo(dict):
    """What a task has worked out already, forgotten as a whole when it reaches ``limit`` entries."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, more: int) -> None:
        if len(self) + more > self.limit:
            self.clear()


_workers: dict[tuple[str, int, int], object] = {}


def per_worker(name: str, data: bytes, build: Callable[[bytes], T]) -> T:
    """What ``build`` makes of a vocabulary, made once in each Python worker; the last of each name is kept."""
    key = (name, len(data), zlib.crc32(data))
    if key not in _workers:
        for old in [known for known in _workers if known[0] == name]:
            del _workers[old]
        _workers[key] = build(data)
    return _workers[key]
