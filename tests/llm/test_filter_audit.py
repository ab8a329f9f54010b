from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from cutlake.llm import filter_audit

from .conftest import DATA

BLANKS = " \t\n\x0b\x0c\r"
sorted_ids = st.sets(st.integers(0, 60)).map(lambda ids: np.array(sorted(ids), np.int32))


@given(sorted_ids, sorted_ids)
def test_merges_of_sorted_lists(a, b):
    assert filter_audit.union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
    assert filter_audit.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
    assert filter_audit.n_common(a, b) == len({*a.tolist()} & {*b.tolist()})


def _words(text):
    for blank in BLANKS:
        text = text.replace(blank, " ")
    return [word for word in text.split(" ") if word]


def _model(docs, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    first = {}
    for row in docs:
        if row["doc_id"] is not None:
            text = row["text"] or ""
            first[text] = min(first.get(text, row["doc_id"]), row["doc_id"])
    rows = []
    for row in docs:
        text, doc = row["text"] or "", row["doc_id"]
        words = _words(text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (doc is not None and first[text] < doc)
        rows.append((row["source"] or "", fails, doc is not None and doc in good, doc is not None and doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            kept = mine
            for step, name in enumerate(order, 1):
                lost = [r for r in kept if name in r[1]]
                kept = [r for r in kept if name not in r[1]]
                failing = [r for r in mine if name in r[1]]
                shapley[name] += len(lost)
                out[part, order, step] = [
                    len(kept), len(lost), len(failing) - len(lost), sum(r[1] == name for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {key: tuple(value) for key, value in out.items()}


def _found(frame):
    rows = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in filter_audit.MEASURES) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    assert _found(filter_audit.op12_filter_audit(spark, DATA)) == _model(docs.collect(), labels.collect())


def test_odd_rows(spark, odd, empty, no_labels):
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (2, None, None), (3, 1, 1), (None, 1, 1)], no_labels.schema)
    assert _found(filter_audit.audit(odd, labels)) == _model(odd.collect(), labels.collect())
    assert filter_audit.audit(empty, labels).count() == 0
    assert _found(filter_audit.audit(odd, no_labels)) == _model(odd.collect(), [])


def test_hot_part_spreads_over_blocks(spark, no_labels, monkeypatch):
    """A part with most of the rows is cut into blocks; ids that repeat stay apart."""
    monkeypatch.setattr(filter_audit, "BLOCK", 16)
    rows = [(i // 3, ["a b # c", "A" * 9, f"text {i % 7}"][i % 3], None, "hot" if i % 5 else "cold", None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    blocks = filter_audit.posting_lists(filter_audit.failures(docs, no_labels)).collect()
    assert len(blocks) > 20 and max(len(r["ids"]) for r in blocks) <= 16 and sum(len(r["ids"]) for r in blocks) == 400
    assert all(r["ids"] == sorted(r["ids"]) for r in blocks)
    assert _found(filter_audit.audit(docs, no_labels)) == _model(docs.collect(), [])
