"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon holds the words that stand out in texts labelled toxic; it is kept as a trie. The
Levenshtein automaton of a word - a few bit vectors that follow one trie edge per step - is
intersected with it, so the walk only enters branches within the allowed edits. Around
each hit a window of words tells quotation (inside quotation marks, or near a word of
saying) from abuse (near a word of address). Sums of the hits, by kind, go through a
logistic regression.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm import logistic
from cutlake.llm.common import Memo, per_worker, read, staged, text_groups, text_or_empty

TRAINING_ROWS = 20_000
LEXICON_TERMS = 4_096
_WORD = re.compile(r"[^\W\d_]+")
# Words of saying and of address, and quotation marks, in four languages.
SAYING = frozenset(
    "said says say quote quoted wrote called term word sagte sagt zitat schrieb wort dit disait mot cite écrit dijo dice palabra cita escribió".split()
)
ADDRESS = frozenset("you your youre u du dich dir ihr euch tu te toi vous ton ta tú ti usted ustedes vosotros".split())
QUOTES = re.compile("[\"“”„«»‹›]")
SPAN = 5
FEATURES = ("exact", "one_edit", "two_edits", "quoted", "addressed", "strongest", "share")


def edits_for(length: int) -> int:
    """Edits within which a word of that length counts as a spelling of a term."""
    return 0 if length < 5 else 1 if length < 12 else 2


def _trie(terms: dict[str, float]) -> tuple[dict, dict[str, dict]]:
    """A trie of dictionaries, in which the key "" holds a term's weight, and its nodes by their path."""
    root: dict = {}
    nodes = {"": root}
    for term, weight in terms.items():
        node = root
        for i, char in enumerate(term):
            node = nodes[term[: i + 1]] = node.setdefault(char, {})
        node[""] = weight
    return root, nodes


def _walk(node: dict, depth: int, word: str, most: int) -> tuple[int, float] | None:
    """Fewest edits, and the highest weight with these, from ``word`` to a term below ``node``.

    The path to the node is the first ``depth`` characters of the word. Bit i of vector j
    says: the path so far is within j edits of the first i characters.
    """
    places: dict[str, int] = {}
    for i, char in enumerate(word):
        places[char] = places.get(char, 0) | 2 << i
    full, every = 1 << len(word), (2 << len(word)) - 1
    near = [((2 << (depth + j)) - (1 << max(0, depth - j))) & every for j in range(most + 1)]
    best: tuple[int, float] | None = None
    stack = [(node, near)]
    while stack:
        node, state = stack.pop()
        for char, below in node.items():
            if char == "":
                for edits, vector in enumerate(state):
                    if vector & full:
                        if best is None or (edits, -below) < (best[0], -best[1]):
                            best = (edits, below)
                        break
                continue
            same = places.get(char, 0)
            new = [state[0] << 1 & same]
            for j in range(1, most + 1):
                before = state[j - 1]
                new.append((state[j] << 1 & same | before | (before | new[-1]) << 1) & every)
            if new[-1]:
                stack.append((below, new))
    return best


class Lexicon:
    """Terms with weights, as one trie of the terms and one of the terms read backwards.

    A word is cut into one part more than it may have edits, and one of the parts stands
    unchanged in any term within reach: at its front, at its end (the front backwards) or
    inside. So a walk starts below the node of the unchanged front, in either trie; only if a
    middle part occurs inside some term does it start at the root.
    """

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.root, self.fronts = _trie(terms)
        self.ends = _trie({term[::-1]: weight for term, weight in terms.items()})[1]
        self.insides = {term[i:j] for term in terms for i in range(len(term)) for j in range(i + 4, len(term) + 1)}

    def closest(self, word: str) -> tuple[int, float] | None:
        """Edits and weight of the nearest term within ``edits_for(len(word))``, the heaviest of these."""
        n = len(word)
        most = edits_for(n)
        if most == 0:
            return (0, self.terms[word]) if word in self.terms else None
        part = n // (most + 1)
        if most == 2 and word[part : 2 * part] in self.insides:
            return _walk(self.root, 0, word, most)
        found = []
        if (node := self.fronts.get(word[:part])) is not None:
            found.append(_walk(node, part, word, most))
        back = word[::-1]
        if (node := self.ends.get(back[: n - most * part])) is not None:
            found.append(_walk(node, n - most * part, back, most))
        return min((x for x in found if x is not None), key=lambda x: (x[0], -x[1]), default=None)


def _features(text: str, lexicon: Lexicon, memo: Memo) -> list[float]:
    words = _WORD.findall(text.lower())
    known = memo
    hits = []
    for i, word in enumerate(words):
        try:
            found = known[word]
        except KeyError:
            found = known[word] = lexicon.closest(word)
        if found is not None:
            hits.append((i, *found))
    if not hits:
        return [0.0] * len(FEATURES)
    starts = [m.start() for m in _WORD.finditer(text.lower())]
    marks = [m.start() for m in QUOTES.finditer(text.lower())]
    opened = np.searchsorted(marks, [starts[i] for i, _, _ in hits])
    by_edits, quoted, addressed = [0.0, 0.0, 0.0], 0.0, 0.0
    for (i, edits, weight), before in zip(hits, opened.tolist(), strict=True):
        near = words[max(0, i - SPAN) : i + SPAN + 1]
        by_edits[edits] += weight
        if (before % 2 == 1 and before < len(marks)) or not SAYING.isdisjoint(near):
            quoted += weight
        if not ADDRESS.isdisjoint(near):
            addressed += weight
    logs = [float(np.log1p(x)) for x in (*by_edits, quoted, addressed, max(w for _, _, w in hits))]
    return [*logs, float(np.log1p(1000 * sum(by_edits) / len(words)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word, in how many texts of either label it stands."""
    count = {0: Counter(), 1: Counter()}
    for batch, texts in text_groups(batches, "text", 1 << 20):
        for text, toxic in zip(texts, batch.column("toxic").to_pylist(), strict=True):
            count[toxic].update({word for word in _WORD.findall(text.lower()) if len(word) > 3})
    words = list(count[1])
    columns = [words, [count[1][w] for w in words], [count[0][w] for w in words]]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["word", "toxic", "clean"])
    rest = [w for w in count[0] if w not in count[1]]
    yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([count[0][w] for w in rest], pa.int64())], ["word", "toxic", "clean"])


def _measure(batches: Iterator[pa.RecordBatch], lexicon: Broadcast, keep: str) -> Iterator[pa.RecordBatch]:
    build = lambda data: (Lexicon(json.loads(data)), Memo(600_000))
    built, memo = per_worker("toxicity", lexicon.value, build)
    for batch, texts in text_groups(batches, "text", 1 << 20):
        memo.room(0)
        rows = [_features(text, built, memo) for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(rows, pa.list_(pa.float64()))], [keep, "features"])


def learn_lexicon(labelled: DataFrame, terms: int = LEXICON_TERMS, least: int = 5, odds: float = 3.0) -> dict[str, float]:
    """Words of 4 letters or more and their log odds: in ``least`` toxic texts, odds of e^``odds`` to 1.

    ``labelled`` has text and toxic (0 or 1). At most ``terms`` words, the heaviest first.
    """
    total = {row["toxic"]: row["n"] for row in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = total.get(1, 0), total.get(0, 0)
    counted = labelled.select("text", "toxic").mapInArrow(_count, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    weight = F.log((F.col("toxic") + 0.5) / F.lit(ones + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(zeros + 1.0))
    heavy = counted.where(F.col("toxic") >= least).select("word", weight.alias("weight")).where(F.col("weight") >= odds)
    return {row["word"]: row["weight"] for row in heavy.orderBy(F.desc("weight"), "word").limit(terms).collect()}


def held_out(doc_id: Column) -> Column:
    """Rows no label of which may be learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and label of at most ``rows`` labelled documents that are not held out, by hash of their id."""
    use = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    use = use.groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "labelled_id")
    # Sent to all: ``rows`` ids at most.
    met = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(use), F.col("doc_id") == F.col("labelled_id"))
    return met.select("doc_id", "text", label)


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row, learned from ``labels.toxic``.

    Learns from ``rows`` labelled documents at most; all rows are scored on their whole texts.
    Null and empty texts have no hits and get the score of such; so do all where no label
    is usable. Other columns and labels are not read.
    """
    spark = docs.sparkSession
    sample = staged(training_rows(docs, labels, "toxic", rows).repartition(32, "doc_id"), "toxicity-sample")
    lexicon = spark.sparkContext.broadcast(json.dumps(learn_lexicon(sample)).encode())
    measured = sample.select("toxic", "text").mapInArrow(
        lambda b: _measure(b, lexicon, "toxic"), "toxic int, features array<double>"
    ).collect()
    x = np.array([row["features"] for row in measured], float).reshape(-1, len(FEATURES))
    weights, intercept = logistic.fit(x, np.array([row["toxic"] for row in measured], float))
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        lambda b: _measure(b, lexicon, "doc_id"), f"doc_id {kind}, features array<double>"
    )
    z = F.lit(intercept)
    for i, weight in enumerate(weights.tolist()):
        z = z + F.lit(weight) * F.get("features", F.lit(i))
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
