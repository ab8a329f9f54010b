"""How filters interact: what each removes, repeats and loses at every place of every order, by merging posting lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import groupby, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import read, staged
from cutlake.llm.quality_rules import words_of

# Rows of one posting block, and sums a task holds before it hands them on.
BLOCK = 1 << 16
HELD_SUMS = 1 << 14
# Ways in which the rows of one text are dealt out.
SALTS = 32
MAX_FILTERS = 8
MARKS = ("good", "toxic")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

Filters = Mapping[str, Column]


def document_filters() -> Filters:
    """The five conditions on ``text`` under which a document fails, all but the one on copies."""
    n_words, upper = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n_words,
        "C": 100 * upper > 2 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
        "E": F.lit(False),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, fails (array of booleans, one per filter), good and toxic of every row.

    Null texts count as empty, a null source is the part ''. A copy is a text that equals that
    of a row with a smaller doc_id (compared by SHA-256); a row without doc_id is none. A
    document is good or toxic if any label row of its id says so.
    """
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = docs.select("doc_id", "part", "text", words_of(F.col("text")).alias("words"))
    found = document_filters()
    seen = staged(worded.select("doc_id", "part", F.array(*found.values()).alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-failures")
    # Only texts that stand under two ids at least can make a copy; the rows of a hot one are salted.
    shared = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    marked = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = seen.join(shared, ["digest", "salt"], "left").join(marked, F.col("doc_id") == F.col("labelled"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    place = list(found).index("E")
    fails = F.transform("fails", lambda x, i: F.when(i == place, copy).otherwise(x))
    return rows.select("part", "doc_id", fails.alias("fails"), *[F.coalesce(mark, F.lit(False)).alias(mark) for mark in MARKS])


_POSTINGS = "part string, ids array<bigint>, " + ", ".join(f"{name} array<int>" for name in MARKS) + ", failing array<array<int>>"


def posting_lists(rows: DataFrame) -> DataFrame:
    """The posting lists of each part, one row per range of ids.

    ``ids`` has the ids of a block's rows in order (nulls first). ``failing`` holds for each
    filter the sorted places, within ``ids``, of the rows that fail it; ``good`` and ``toxic``
    are such lists as well. Places keep repeated ids apart. A block has at most BLOCK rows, so
    a hot part, or one id with many rows, spreads over blocks and tasks.
    """
    ordered = rows.select("part", "doc_id", "fails", *MARKS, F.spark_partition_id().alias("salt"))
    ordered = ordered.repartitionByRange("part", "doc_id", "salt").sortWithinPartitions("part", "doc_id").drop("salt")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _parts(batch.column("part")):
                for low in range(start, stop, BLOCK):
                    block = batch.slice(low, min(BLOCK, stop - low))
                    flat = block.column("fails").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                    lists = {mark: np.flatnonzero(block.column(mark).to_numpy(zero_copy_only=False)).tolist() for mark in MARKS}
                    row = {"part": block.column("part")[0].as_py(), "ids": block.column("doc_id").to_pylist(), **lists}
                    row["failing"] = [np.flatnonzero(column).tolist() for column in flat.T]
                    yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return ordered.mapInArrow(build, _POSTINGS)


_INTS = pa.list_(pa.int32())
_SCHEMA = pa.schema(
    [("part", pa.string()), ("ids", pa.list_(pa.int64())), *[(mark, _INTS) for mark in MARKS], ("failing", pa.list_(_INTS))]
)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and stop of each run of equal values."""
    start = 0
    for _, run in groupby(column.to_pylist()):
        stop = start + sum(1 for _ in run)
        yield start, stop
        start = stop


def places(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each entry of the shorter sorted list goes in the longer one, and whether it stands there.

    The search gallops: it starts at the last place found, as the entries rise.
    """
    at = np.searchsorted(long, short)
    return at, long[np.minimum(at, len(long) - 1)] == short if len(long) else np.zeros(len(short), bool)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries of sorted ``a`` that sorted ``b`` lacks."""
    if len(a) <= len(b):
        return a[~places(a, b)[1]]
    at, there = places(b, a)
    return np.delete(a, at[there])


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists merged, common entries once."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at, there = places(short, long)
    return np.insert(long, at[~there], short[~there])


def n_common(a: np.ndarray, b: np.ndarray) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(places(short, long)[1].sum())


def block_sums(failing: list[np.ndarray], marks: list[np.ndarray], n_rows: int) -> np.ndarray:
    """For each set of earlier filters and each filter: kept, removed, redundant, unique, the marks lost, Shapley sum.

    Every figure is a count within the block, so blocks add up. Sets are bit masks; entries
    where the filter is in the set stay zero.
    """
    k = len(failing)
    unions = [np.zeros(0, np.int32)]
    for mask in range(1, 1 << k):
        top = mask.bit_length() - 1
        unions.append(union(unions[mask ^ (1 << top)], failing[top]))
    sums = np.zeros((1 << k, k, 5 + len(marks)), np.int64)
    for mask in range(1 << k):
        weight = factorial(bin(mask).count("1")) * factorial(k - 1 - bin(mask).count("1")) if mask + 1 < 1 << k else 0
        for i in range(k):
            if mask >> i & 1:
                continue
            removed = difference(failing[i], unions[mask])
            lost = [n_common(removed, mark) for mark in marks]
            sums[mask, i, : 3 + 1] = n_rows - len(unions[mask | 1 << i]), len(removed), len(failing[i]) - len(removed), 0
            sums[mask, i, 4:-1] = lost
            sums[:, i, -1] += weight * len(removed)
    for i in range(k):
        rest = ((1 << k) - 1) ^ (1 << i)
        sums[:, i, 3] = sums[rest, i, 1]
    return sums


_SUMS = "part string, earlier int, filter int, " + ", ".join(f"{name} bigint" for name in MEASURES)


def merged(postings: DataFrame, n_filters: int) -> DataFrame:
    """The measures per part, filter and set of filters before it (``earlier``, a bit mask), summed over all blocks."""
    if not 0 < n_filters <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters")
    pairs = [(mask, i) for mask in range(1 << n_filters) for i in range(n_filters) if not mask >> i & 1]

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, sums in held.items():
            figures = np.stack([sums[mask, i] for mask, i in pairs])
            columns = [pa.array([part] * len(pairs), pa.string())]
            columns += [pa.array(x, pa.int32()) for x in zip(*pairs, strict=True)] + [pa.array(x, pa.int64()) for x in figures.T]
            yield pa.RecordBatch.from_arrays(columns, ["part", "earlier", "filter", *MEASURES])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                failing = [np.asarray(x.values.to_numpy(), np.int32) for x in batch.column("failing")[i]]
                marks = [np.asarray(batch.column(mark)[i].values.to_numpy(), np.int32) for mark in MARKS]
                sums = block_sums(failing, marks, len(batch.column("ids")[i]))
                held[part] = held[part] + sums if part in held else sums
                if len(held) * len(pairs) > HELD_SUMS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    found = postings.mapInArrow(merge, _SUMS)
    return found.groupBy("part", "earlier", "filter").agg(*[F.sum(name).alias(name) for name in MEASURES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the measures, for every part, order of the filters and step.

    ``docs`` has doc_id, source and text, ``labels`` doc_id, quality and toxic; see
    ``failures`` for nulls, repeated rows and labels. Each row counts, repeated ones too. An
    empty table has no parts. Other columns are not read.
    """
    names = "".join(document_filters())
    postings = staged(posting_lists(failures(docs, labels)), "posting-lists")
    sums = merged(postings, len(names))
    steps = []
    for order in map("".join, permutations(names)):
        for step, name in enumerate(order):
            steps.append((order, step + 1, sum(1 << names.index(x) for x in order[:step]), names.index(name)))
    # Orders times steps: a fixed number of rows, whatever the tables hold.
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, earlier int, filter int")
    return sums.join(F.broadcast(orders), ["earlier", "filter"]).select("part", "filter_order", "step", *MEASURES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by source."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return audit(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (
  SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(list_slice(bits, 1, step - 1)), 0) AS INTEGER) AS earlier
  FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n * good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n * toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
