"""Classifiers on held-out rows, packing against a plain packer, the pipeline stage by stage."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutlake.llm import logistic, packing, quality_classifier, toxicity
from cutlake.llm.common import staged

from .conftest import DATA

LARGER = "/root/testdata/sf0.1"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))
    terms = {word(): rng.randint(1, 3) / 2 for _ in range(60)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(600):
        one = word()
        near = sorted((d, -w) for t, w in terms.items() if (d := _distance(one, t)) <= toxicity.edits_for(len(one)))
        assert lexicon.closest(one) == ((near[0][0], -near[0][1]) if near else None)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"stupid": 2.0})
    scores = {t: toxicity._features(t, lexicon, toxicity.Memo(99)) for t in ("you are stupidd", 'he said "stupid" to them', "that is stupid")}
    quoted, addressed = toxicity.FEATURES.index("quoted"), toxicity.FEATURES.index("addressed")
    assert [x[quoted] > 0 for x in scores.values()] == [False, True, False]
    assert [x[addressed] > 0 for x in scores.values()] == [True, False, False]
    assert [x[toxicity.FEATURES.index("one_edit")] > 0 for x in scores.values()] == [True, False, False]


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op1_toxicity(spark, LARGER).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert logistic.ranked_above(*map(np.array, zip(*held, strict=True))) > 0.9


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_quality_on_held_out_rows(spark):
    rows = quality_classifier.op8_quality_classifier(spark, LARGER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 10_000
    assert logistic.ranked_above(*map(np.array, zip(*held, strict=True))) > 0.95


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 3000).astype(float)
    sides = [rng.normal(size=(3000, 5)) + 1.5 * truth[:, None] * (np.arange(5) == k) for k in range(2)]
    use = np.arange(3000) < 60
    model = quality_classifier.co_train([x[use] for x in sides], truth[use], np.arange(60) % 4 == 0, [x[~use] for x in sides])
    both = logistic.ranked_above(model.odds(sides[0][~use], sides[1][~use]), truth[~use])
    assert both > max(logistic.ranked_above(v.odds(x[~use]), truth[~use]) for v, x in zip((model.content, model.metadata), sides, strict=True))


@pytest.mark.parametrize("labels", ["none", "one", "odd"])
def test_classifiers_on_odd_rows(spark, odd, empty, no_labels, labels):
    given = {"none": [], "one": [(0, 1, 0), (1, 1, 0)], "odd": [(0, 1, 0), (0, 0, 1), (1, 0, 1), (None, 1, 1), (2, None, None), (6, 1, 0), (10, 7, 7), (99, 0, 1)]}
    table = spark.createDataFrame(given[labels], no_labels.schema)
    scored = toxicity.score(odd, table).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    judged = quality_classifier.score(odd, table).collect()
    assert len(judged) == odd.count() and all(0 <= r["score"] <= 1 for r in judged)
    kept = quality_classifier.keep_good(odd, table)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["score"] >= 0.5 for r in judged)
    assert toxicity.score(empty, table).count() == quality_classifier.keep_good(empty, table).count() == 0


SHARD = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("group", pa.int64()), ("mark", pa.int64()), ("shard", pa.int32())])


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_the_tightest_compatible_fit(seed):
    rng = random.Random(seed)
    capacity, n = rng.choice([7, 16, 100, 2048]), rng.choice([0, 1, 40, 700])
    size = lambda: rng.choice([rng.randint(0, capacity), rng.randint(0, 4 * capacity)])
    rows = [dict(doc_id=i, source=rng.choice([*"aaabcd", None]), size=size(), group=rng.choice([None, rng.randint(0, n // 3)]), mark=0, shard=0) for i in range(n)]
    got = packing._pack(pa.Table.from_pylist(rows, schema=SHARD), capacity).to_pylist()
    pieces = []
    for row in rows:
        whole, rest = divmod(row["size"], capacity)
        pieces += [(row, part, capacity) for part in range(whole)] + [(row, whole, rest)] * bool(rest or not whole)
    bins = []
    clash = lambda a, b, name: a[name] is not None and a[name] == b[name]
    for row, part, size in sorted(pieces, key=lambda p: (-p[2], p[0]["doc_id"], p[1])):
        fits = [(free, i) for i, (free, held) in enumerate(bins) if free >= size and held[0][2] < capacity and not any(clash(x, row, "source") or clash(x, row, "group") for x, *_ in held)]
        if not fits or size == capacity:
            bins.append((capacity, []))
        at = min(fits)[1] if fits and size < capacity else len(bins) - 1
        bins[at] = (bins[at][0] - size, [*bins[at][1], (row, part, size)])
    assert {(r["doc_id"], r["part"]): r["bin"] for r in got} == {(row["doc_id"], part): i for i, (_, held) in enumerate(bins) for row, part, _ in held}


def _check_packing(rows, docs, capacity):
    """Nothing lost, nothing over, no conflict."""
    length = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        length[r["doc_id"]] += r["size"]
        bins[r["shard"], r["bin"]].append(r)
    sizes = {i: -(-len((t or "").encode()) // 4) for i, (t, _) in docs.items()}
    assert length == sizes
    for held in bins.values():
        assert sum(r["size"] for r in held) <= capacity
        assert sorted(r["offset"] for r in held) == [sum(r["size"] for r in sorted(held, key=lambda r: (r["offset"], r["size"]))[:k]) for k in range(len(held))]
        for a, b in combinations([docs[r["doc_id"]] for r in held], 2):
            assert a[1] is None or a[1] != b[1]
            assert not a[0] or a[0] != b[0]


def test_packing_query_and_odd_rows(spark, odd, empty):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    _check_packing(packing.op2_packing(spark, DATA).collect(), docs, packing.CAPACITY)
    single = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in single.collect()}
    _check_packing(packing.pack(single, packing.estimated_tokens(F.col("text")), capacity=64, shard_rows=5).collect(), docs, 64)
    assert packing.pack(odd, packing.estimated_tokens(F.col("text"))).where("part = 0").count() == odd.count()
    assert packing.pack(empty, packing.estimated_tokens(F.col("text"))).count() == 0


def test_pipeline_stages(spark):
    from cutlake.llm import quality_rules

    from .test_duplicates import _fingerprint, _groups, _without_repeats

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [{r["doc_id"]: r for r in docs.collect()}]
    verdicts = quality_rules.quality(docs).collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        tables.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.count() == len(tables[-1])
    raw, ruled, scored, cut, single = tables
    assert set(ruled) == {r["doc_id"] for r in verdicts if r["kept"]} and all(ruled[i] == raw[i] for i in ruled)
    assert set(scored) <= set(ruled) and len(scored) > 0.9 * len(ruled)
    assert {i: r["text"] for i, r in cut.items()} == _without_repeats({i: r["text"] for i, r in scored.items()})
    ids = sorted(cut)
    group = _groups([_fingerprint(cut[i]["text"]) for i in ids])
    assert set(single) == {min(i for i, h in zip(ids, group, strict=True) if h == g) for g in set(group)}
    name, stage = corpus_pipeline.STAGES[-1]
    _check_packing(stage(spark, docs, DATA).collect(), {i: (r["text"], r["source"]) for i, r in single.items()}, packing.CAPACITY)
    assert corpus_pipeline.run(spark, DATA).count() >= len(single)


def test_pipeline_on_an_empty_table(spark, empty, no_labels, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
