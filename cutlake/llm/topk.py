"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of rows, each held as one posting list per dimension.
Queries are sparse rows of (dimension, weight), packed into blocks too. Every query block
meets every candidate block - a stated query set against all rows, in blocks. There the
weights of one dimension after another are scattered, times its postings, into dense score
arrays, and partition selection keeps the k best of the block. The k best of all blocks
are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlake.llm.common import read, staged

CANDIDATES = 4096
QUERIES = 256
_BLOCK = "block long, ids array<long>, dims array<int>, slots array<int>, weights array<long>"


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every component; rows without a whole finite vector go."""
    value = F.col(column)
    # A null component makes forall null, which also lets the row go.
    finite = F.forall(value, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector")
    )


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` rows as postings: sorted by dimension, zero weights left out."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    ids: list[int] = []
    rows: list[list[int]] = []

    def block() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for row in rows for x in row), np.int64, int(lengths.sum()))
        slot = np.repeat(np.arange(len(rows)), lengths)
        dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((slot, dim))
        order = order[flat[order] != 0]
        columns = [[number], [ids], [dim[order]], [slot[order]], [flat[order]]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["block", "ids", "dims", "slots", "weights"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for one, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            ids.append(one)
            rows.append(vector)
            if len(ids) == size:
                yield block()
                number, ids, rows = number + 1, [], []
    if ids:
        yield block()


class _Postings:
    """One side of a block pair."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str):
        def values(name: str) -> np.ndarray:
            return batch.column(prefix + name)[row].values.to_numpy()

        self.ids, self.slots, self.weights = values("ids"), values("slots"), values("weights")
        dims = values("dims")
        cut = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]) if len(dims) else np.zeros(0, np.int64)
        self.spans = dict(zip(dims[cut].tolist(), zip(cut.tolist(), [*cut[1:].tolist(), len(dims)], strict=True), strict=True))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")][: k - len(above)]
        places = np.r_[above, level]
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            queries, cands = _Postings(batch, row, "q_"), _Postings(batch, row, "c_")
            scores = np.zeros((len(queries.ids), len(cands.ids)), np.int64)
            for dim, (first, stop) in queries.spans.items():
                if dim not in cands.spans:
                    continue
                i, j = cands.spans[dim]
                slots, weights = cands.slots[i:j], cands.weights[i:j]
                whole = j - i == len(cands.ids)
                for slot, weight in zip(queries.slots[first:stop].tolist(), queries.weights[first:stop].tolist(), strict=True):
                    if whole:
                        scores[slot] += weight * weights
                    else:
                        scores[slot, slots] += weight * weights
            asked, ids, found = [], [], []
            for slot, query in enumerate(queries.ids.tolist()):
                other = np.flatnonzero(cands.ids != query)
                best = other[_best(scores[slot, other], cands.ids[other], k)]
                asked.append(np.full(len(best), query))
                ids.append(cands.ids[best])
                found.append(scores[slot, best])
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, ids, found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query.

    ``vectors`` has vec_id and an integer array; a query is a row for which ``is_query`` on
    vec_id holds, a candidate any row with another vec_id. Vectors of different lengths count
    as padded with zeros; sums wrap at 64 bits. Ties go to the smaller vec_id. Rows that
    repeat a vec_id should be made unique before; each counts as its own row here. Other
    columns are not read.
    """
    vectors = vectors.select("vec_id", "vector")
    cands = staged(vectors.mapInArrow(lambda b: _pack(b, CANDIDATES), _BLOCK), "candidate-blocks")
    queries = staged(vectors.where(is_query).coalesce(8).mapInArrow(lambda b: _pack(b, QUERIES), _BLOCK), "query-blocks")
    # Block numbers, one per some thousand rows: each query block is dealt to all of them.
    numbered = cands.select(F.col("block").alias("number"), (F.row_number().over(Window.orderBy("block")) - 1).alias("slot"))
    count = cands.count()
    slots = F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")
    dealt = queries.select(F.col("block").alias("q_block"), F.explode(slots).alias("slot"))
    q = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    c = numbered.join(cands, F.col("number") == F.col("block")).select("slot", *[F.col(c).alias(f"c_{c}") for c in cands.columns])
    met = dealt.join(q, "q_block").join(c, "slot")
    found = met.mapInArrow(lambda b: _score(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all embeddings for every hundredth one."""
    vectors = quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, generate_subscripts(e, 1) AS d, unnest(e) AS w FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM p q JOIN p c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
