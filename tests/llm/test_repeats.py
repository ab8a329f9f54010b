"""Repeated passages against counts that know nothing of lines and chunks."""

import random

from cutlake.llm import line_dedup

from .conftest import DATA

WINDOW = 51


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"].split() for r in line_dedup.dedup(docs).orderBy("doc_id").collect()]


def _planted(spark, passage, seed):
    """How many words of the passage stay in the second of two texts that hold it; the first keeps all."""
    one, two = (f"{' '.join(_words(seed + i, 40))}, {passage} {' '.join(_words(seed + i + 2, 40))}." for i in range(2))
    first, second = _kept(spark, [one, two])
    assert first == one.split() and set(_words(seed + 1, 40)[:30]) <= set(second)
    return len(set(passage.split()) & set(second))


def test_clause_without_punctuation(spark):
    assert _planted(spark, " ".join(_words(1, 150)), 100) <= 30


def test_many_short_lines(spark):
    assert _planted(spark, "".join(f"{w}\n" for w in _words(2, 100)), 200) <= 20


def test_short_clauses_one_passage(spark):
    # Each chunk is under 32 characters, and far from 20 words with its neighbours.
    assert _planted(spark, "".join(f"{w[:3]}!! " for w in _words(3, 120)), 300) <= 20


def test_rounds_of_few_words(spark):
    for rounds in (["tior"], ["tior,"], ["titionly.", "erheed."]):
        assert len(_kept(spark, [" ".join(rounds * 400)])[0]) <= 80


def test_chance_matches_stay(spark):
    # Two common short sentences stand in both texts, within different ones.
    texts = [f"{' '.join(_words(i, 30))}. Yes, it is. No, never. {' '.join(_words(i + 50, 30))}." for i in (400, 500)]
    assert _kept(spark, texts) == [t.split() for t in texts]


def test_neighbours_are_kept_as_text(spark, monkeypatch):
    """Hashes of the lines around a chunk don't compress, and only those that match are counted."""
    kept, stage = {}, line_dedup.staged

    def watched(df, purpose):
        kept[purpose] = dict(df.dtypes)
        return stage(df, purpose)

    monkeypatch.setattr(line_dedup, "staged", watched)
    assert _planted(spark, " ".join(_words(7, 150)), 600) <= 30
    assert kept["chunk-lines"]["before"] == kept["chunk-lines"]["after"] == "array<string>"


def test_matched_neighbours_are_kept_once(spark, monkeypatch):
    """A chunk whose neighbour is looked up itself carries no copy of it."""
    kept, stage = {}, line_dedup.staged

    def watched(df, purpose):
        kept[purpose] = stage(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(line_dedup, "staged", watched)
    assert _planted(spark, ", ".join(_words(8, 300)), 700) <= 30
    rows = kept["chunk-lines"].collect()
    assert len(rows) > 20
    assert sum(len(r["before"]) + len(r["after"]) for r in rows) < 0.5 * sum(len(r["body"]) for r in rows)


def _repeated(docs):
    seen, found = set(), 0
    for i in sorted(docs):
        words, last = (docs[i] or "").split(), 0
        for k in range(len(words) - WINDOW + 1):
            window = tuple(words[k : k + WINDOW])
            if window in seen:
                found += k + WINDOW - max(last, k)
                last = k + WINDOW
            seen.add(window)
    return found


def test_recall_on_a_table(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    after = {r["doc_id"]: r["text"] for r in line_dedup.op9_line_dedup(spark, DATA).collect()}
    assert _repeated(before) > 5_000
    assert _repeated(after) <= 0.1 * _repeated(before)
