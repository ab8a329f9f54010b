"""Quality classifier by co-training two views of a document.

The content view counts the shapes of words (letters, digits and signs, runs collapsed) and
how words repeat; the metadata view sees language, source, length and line lengths, never
words. Both are logistic regressions. In each round either view labels the documents of an
unlabelled pool that it is most sure of, for the other one to learn from. At the end each
is calibrated on labelled rows neither has learned from, and the calibrated log odds are
added, less the prior that both hold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutlake.llm import logistic
from cutlake.llm.common import Memo, read, staged, text_groups, text_or_empty
from cutlake.llm.toxicity import held_out

LABELLED_ROWS = 20_000
POOL_ROWS = 20_000
ROUNDS = 3
PER_ROUND = 500
SURE = 0.9
SHAPES = 64
PLACES = 32
CONTENT = SHAPES + 4
METADATA = 2 * PLACES + 5


def _bucket(value: str, size: int) -> int:
    return zlib.crc32(value.encode()) % size


def shape(word: str) -> str:
    """Letters as a (capitals as A), digits as 0, all other characters as they are, runs as one."""
    letters = "A" if word.isupper() else "a"
    text = re.sub(r"[^\W\d_]+", letters, re.sub(r"\d+", "0", word))
    return re.sub(r"(.)\1+", r"\1", text)[:8]


def content_features(text: str, memo: Memo) -> list[float]:
    """Shares of word shapes, of equal neighbours and of different words, length of words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * CONTENT
    try:
        found = list(map(memo.__getitem__, words))
    except KeyError:
        for word in words:
            if word not in memo:
                memo[word] = _bucket(shape(word), SHAPES)
        found = list(map(memo.__getitem__, words))
    counts = np.bincount(found, minlength=SHAPES) / n
    chars = len(text) - text.count(" ")
    pairs = sum(map(eq, words, words[1:])) / n
    return [*np.sqrt(counts).tolist(), float(np.sqrt(pairs)), len(set(words)) / n, chars / n / 10, float(np.log1p(n) / 10)]


def metadata_features(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Language and source by hashed place; length as stated, number of lines and their lengths."""
    places = [0.0] * (2 * PLACES)
    places[_bucket(lang or "", PLACES)] = 1.0
    places[PLACES + _bucket(source or "", PLACES)] = 1.0
    lines = text.count("\n") + 1
    logs = np.log1p([max(n_chars or 0, 0), lines, len(text) / lines]) / 10
    return [*places, *logs.tolist(), float(not text), float(text.endswith("\n"))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo(500_000)
    for batch, texts in text_groups(batches, "text", 1 << 20):
        memo.room(0)
        given = zip(texts, *[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")], strict=True)
        both = [(content_features(text, memo), metadata_features(text, *rest)) for text, *rest in given]
        kind = pa.list_(pa.float32())
        columns = [batch.column("doc_id"), pa.array([x for x, _ in both], kind), pa.array([x for _, x in both], kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "metadata"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of both views of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(_measure, f"doc_id {kind}, content array<float>, metadata array<float>")


@dataclass
class View:
    """A linear classifier and its calibration."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.intercept) + self.shift


@dataclass
class CoTrained:
    content: View
    metadata: View
    prior: float

    def odds(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return self.content.odds(content) + self.metadata.odds(metadata) - self.prior


def co_train(labelled: list[np.ndarray], y: np.ndarray, calibrate: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, per_round: int = PER_ROUND, sure: float = SURE) -> CoTrained:
    """Train both views (content, metadata); rows where ``calibrate`` holds only calibrate.

    A round takes from each view at most ``per_round`` documents of the pool that it gives
    at least ``sure`` of a class, in the classes' proportion, as labels for the other view.
    """
    learn = ~calibrate
    share = float(y[learn].mean()) if learn.any() else 0.5
    taken = [np.full(len(pool[0]), -1), np.full(len(pool[0]), -1)]
    views: list[View] = []
    for turn in range(rounds + 1):
        views = []
        for k in range(2):
            extra = np.flatnonzero(taken[k] >= 0)
            x = np.vstack([labelled[k][learn], pool[k][extra]])
            target = np.r_[y[learn], taken[k][extra]]
            views.append(View(*logistic.fit(x, target, np.r_[np.ones(int(learn.sum())), np.full(len(extra), 0.5)])))
        if turn == rounds:
            break
        for k in range(2):
            p = logistic.sigmoid(views[k].odds(pool[k]))
            other = taken[1 - k]
            for label, certain, part in ((1, p, share), (0, 1 - p, 1 - share)):
                free = np.flatnonzero((other < 0) & (certain >= sure))
                best = free[np.argsort(-certain[free], kind="stable")][: int(per_round * part)]
                other[best] = label
    for k in range(2):
        z = views[k].odds(labelled[k][calibrate])
        slope, shift = logistic.fit(z[:, None], y[calibrate], l2=0.01)
        views[k].slope, views[k].shift = float(slope[0]), shift
    rest = float(y[calibrate].mean()) if calibrate.any() else share
    prior = float(np.log(max(rest, 1e-3) / max(1 - rest, 1e-3)))
    return CoTrained(*views, prior)


def learn(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained:
    """Co-train on bounded samples: labelled rows that are not held out, and unlabelled rows, by hash of their id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    use = known.where(~held_out(F.col("doc_id"))).orderBy(*by_hash).limit(labelled_rows)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(known.select("doc_id"), "doc_id", "left_anti").orderBy(*by_hash).limit(pool_rows)
    chosen = use.unionByName(free.select("doc_id", F.lit(-1).alias("quality"))).withColumnRenamed("doc_id", "chosen_id")
    # Sent to all: no more ids than the two bounds.
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    narrow = staged(narrow.drop("chosen_id").repartition(32, "doc_id"), "quality-sample")
    quality = narrow.select(F.col("doc_id").alias("of_id"), "quality").distinct()
    measured = features(narrow).join(F.broadcast(quality), F.col("doc_id") == F.col("of_id"))
    part = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    # Packed arrays: no more rows than the two bounds.
    rows = measured.select("quality", part.alias("part"), "content", "metadata").toArrow().combine_chunks()
    y = rows.column("quality").to_numpy().astype(float)
    sides = [
        rows.column(name).combine_chunks().flatten().to_numpy().astype(float).reshape(-1, width)
        for name, width in (("content", CONTENT), ("metadata", METADATA))
    ]
    given = y >= 0
    calibrate = rows.column("part").to_numpy().astype(bool)[given]
    return co_train([x[given] for x in sides], y[given], calibrate, [x[~given] for x in sides])


def _dot(name: str, view: View):
    """The calibrated log odds of a view as a column."""
    z = F.lit(float(view.slope * view.intercept + view.shift))
    weights = F.lit([float(view.slope * w) for w in view.weights])
    return z + F.aggregate(F.zip_with(F.col(name), weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)


def score(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """doc_id, score (chance of good quality), content_score and metadata_score of every row.

    Learns from ``train_on``, by default from ``docs``. Null texts count as empty, null
    metadata as a value of its own. Repeated rows keep their rows. Where no label is usable
    all scores are what the prior gives. Other columns are not read.
    """
    model = learn(docs if train_on is None else train_on, labels)
    content, metadata = _dot("content", model.content), _dot("metadata", model.metadata)
    odds = features(docs).select("doc_id", content.alias("c"), metadata.alias("m"))
    chance = lambda z: 1 / (1 + F.exp(-z))
    return odds.select("doc_id", chance(F.col("c") + F.col("m") - model.prior).alias("score"), chance(F.col("c")).alias("content_score"), chance(F.col("m")).alias("metadata_score"))


def keep_good(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """The rows whose score is ``least`` or more, with all their columns, whatever these are called."""
    model = learn(docs if train_on is None else train_on, labels)
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rows = docs.select(row.alias("row"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(500_000)
        for rows, texts in text_groups(batches, "text", 1 << 20):
            memo.room(0)
            given = list(zip(texts, *[rows.column(c).to_pylist() for c in ("lang", "source", "n_chars")], strict=True))
            content = np.array([content_features(text, memo) for text, *_ in given], np.float32)
            metadata = np.array([metadata_features(*one) for one in given], np.float32)
            good = logistic.sigmoid(model.odds(content.astype(float), metadata.astype(float))) >= least
            yield rows.select(["row"]).filter(pa.array(good))

    return rows.mapInArrow(judged, StructType([rows.schema["row"]])).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, and whether it is kept."""
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "content_score", "metadata_score", (F.col("score") >= 0.5).alias("kept"))
