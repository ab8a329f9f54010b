"""SimHash groups, repeated passages and top-k search against brute force."""

import re
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from cutlake.llm import line_dedup, quality_rules, simhash, topk
from cutlake.llm.components import components

from .conftest import DATA


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def _check_groups(rows, texts):
    """rows: (doc_id, fp, component_id) in the order of texts."""
    prints = [_fingerprint(t) for t in texts]
    assert [r[1] & (2**64 - 1) for r in rows] == prints
    group = _groups(prints)
    least = {}
    for g, r in zip(group, rows, strict=True):
        ids = [x for x in (least.get(g), r[0]) if x is not None]
        least[g] = min(ids) if ids else None
    assert [r[2] for r in rows] == [least[g] for g in group]


def test_any_four_places_hold_a_block():
    assert len(set(simhash.BLOCKS)) == 20
    assert all(any(set(b) <= set(four) for b in simhash.BLOCKS) for four in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [1024, 1])
def test_simhash_on_a_table(spark, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sorted(tuple(r) for r in simhash.near_duplicates(docs, limit).collect())
    _check_groups(rows, [texts[r[0]] for r in rows])


@pytest.mark.parametrize("limit", [1024, 2])
def test_links_of_close_values(spark, limit):
    rng = np.random.default_rng(4)
    values = {0}
    for base in rng.integers(0, 2**63, 6).tolist():
        for _ in range(25):
            value = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                value ^= 1 << bit
            values.add(value - 2**64 if value >= 2**63 else value)
    values = sorted(values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), limit).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        root[find(r["a"])] = find(r["b"])
    group = _groups([v & (2**64 - 1) for v in values])
    assert len(set(zip(group, map(find, values), strict=True))) == len(set(group)) == len(set(map(find, values)))


def test_simhash_odd_rows(odd, empty):
    rows = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    texts = {(r[0], r[1]) for r in odd.select("doc_id", "text").collect()}
    by_id = {i: t for i, t in texts if i is not None}
    known = [(r, by_id[r[0]]) for r in rows if r[0] is not None]
    assert len(rows) == odd.count()
    for r, t in known:
        assert r[1] & (2**64 - 1) == _fingerprint(t)
    assert {r[2] for r in rows if r[1] == 0} == {3}
    zeroth = next(r[1] for r in rows if r[0] == 0)
    assert {r[2] for r in rows if r[1] == zeroth} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted({r[2] for r in rows}, key=str)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 50), (50, 50), (7, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 0, 100: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _signed(value):
    return value - 2**64 if value >= 2**63 else value


ODD, EVEN = "bdfhjlnprtvxzBDFHJLNPRTVXZ", "acegikmoqsuwyACEGIKMOQSUWY"


def _lines(text):
    """Physical lines, clauses, and runs of words of what is over 64 bytes."""
    parts, start = [], 0
    for i, c in enumerate(text, 1):
        after_word = c == " " and i > start and (text[i - 2 : i - 1] in tuple(".,;:!?") or (
            i >= 4 and text[i - 4] in ODD and text[i - 3] in EVEN and text[i - 2] in ODD))
        if c == "\n" or after_word:
            parts.append(text[start:i])
            start = i
    lines = []
    for part in [*parts, text[start:]]:
        if len(part.encode()) <= 64:
            lines += [part] if part else []
            continue
        words = [w for w in re.split(r"(?<=[ \t\x0b\x0c\r])", part) if w]
        h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
        run = ""
        for k, word in enumerate(words):
            run += word
            lowest = 0 < k < len(words) - 1 and h[k - 1] > h[k] < h[k + 1]
            if lowest or k == len(words) - 1 or (k % 8 == 7 and h[k] == h[k - 1]):
                lines.append(run)
                run = ""
    return lines


def _lines_and_chunks(text):
    lines = _lines(text or "")
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    turn = lambda v: (v << 1 | v >> 63) & (2**64 - 1)
    n = len(lines)
    feed = [x.endswith("\n") for x in lines]
    opens = [(i == 0 or feed[i - 1]) and not feed[i] for i in range(n)]
    roll = [_signed(h ^ (turn(hashes[i - 1]) if i and not opens[i] else 0)) for i, h in enumerate(hashes)]
    lowest = [0 < i < n - 1 and not opens[i] and roll[i] < roll[i - 1] and roll[i] < roll[i + 1] for i in range(n)]
    same = [i % 4 == 3 and roll[i] == roll[i - 1] for i in range(n)]
    ends = [i + 1 for i in range(n) if i == n - 1 or (i and feed[i] and not feed[i - 1]) or lowest[i] or same[i]]
    return lines, list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def _without_repeats(docs):
    """Chunks of two lines or more against their first place, matches joined where they go on from one another."""
    cut = {i: _lines_and_chunks(t) for i, t in docs.items()}
    first, latest = {}, {}
    runs = defaultdict(set)
    for i in sorted(cut):
        lines, chunks = cut[i]
        for k, (a, e) in enumerate(chunks):
            key = tuple(lines[a:e])
            if e - a < 2:
                continue
            if key not in first:
                first[key] = (i, k)
                continue
            source, m = first[key]
            other, spans = cut[source]
            b, f = spans[m]
            body = set(range(a, e))
            # One chunk up and one down, as far as the lines are the same.
            up = down = 0
            while k and m and a - up > chunks[k - 1][0] and b - up > spans[m - 1][0] and lines[a - up - 1] == other[b - up - 1]:
                up += 1
            ahead = k + 1 < len(chunks) and m + 1 < len(spans)
            while ahead and e + down < chunks[k + 1][1] and f + down < spans[m + 1][1] and lines[e + down] == other[f + down]:
                down += 1
            runs[i, source, a - b] |= body | set(range(a - up, e + down))
            # Where it stood last in this text, the first place aside.
            if (i, key) in latest:
                runs[i, i, a - latest[i, key]] |= body
            latest[i, key] = a
    gone = defaultdict(set)
    for (i, _, _), held in runs.items():
        lines = cut[i][0]
        for line in sorted(held):
            if line - 1 in held:
                continue
            end = line
            while end in held:
                end += 1
            if sum(len(_words_of(lines[x])) for x in range(line, end)) >= line_dedup.MIN_WORDS:
                gone[i] |= set(range(line, end))
    return {i: "".join(x for n, x in enumerate(lines) if n not in gone[i]) for i, (lines, _) in cut.items()}


def _words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_line_dedup_on_a_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in line_dedup.op9_line_dedup(spark, DATA).collect()}
    expected = _without_repeats(docs)
    assert {i: r["text"] or "" for i, r in got.items()} == expected
    assert all(r["n_removed"] == len(docs[i] or "") - len(expected[i]) for i, r in got.items())
    assert any(r["n_removed"] for r in got.values())


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.dedup(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[4]["text"] is None and by_id[3]["text"] == "" and by_id[5]["text"] == " \t\n "
    assert by_id[10]["text"].count("the baker walks down to the mill") == 1
    assert "the baker" not in by_id[11]["text"] and by_id[11]["text"].startswith("Something else, quite.")
    assert by_id[11]["n_chars"] == len(by_id[11]["text"])
    assert len({r["text"] for r in rows if r["doc_id"] == 0}) == 1
    assert line_dedup.dedup(empty).count() == 0


def test_topk_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 2]) for i in range(300)]
    vectors += [(300, [1.0] * 6), (301, [1.0] * 6), (400, None), (500, [1.0, nan]), (600, [inf, 1.0]), (700, [None, 1.0]), (None, [1.0] * 6), (800, []), (900, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    from pyspark.sql import functions as F

    got = {}
    for r in topk.top_k(topk.quantised(frame), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in vectors if i is not None and i not in (400, 500, 600, 700)}
    dot = lambda a, b: int(sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=False)))
    for query in (i for i in good if i % 100 == 0):
        best = sorted((-dot(good[query], v), i) for i, v in good.items() if i != query)[:10]
        assert sorted(got[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {i for i in good if i % 100 == 0}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantised(none), F.col("vec_id") % 100 == 0).count() == 0


def test_quality_measures_by_hand(odd, empty):
    rows = quality_rules.quality(odd).collect()
    assert len(rows) == odd.count()
    for r, text in [(next(r for r in rows if r["doc_id"] == i), t) for i, t in {(x["doc_id"], x["text"]) for x in odd.select("doc_id", "text").collect() if x["doc_id"] is not None}]:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many = {w for w, n in zip(*np.unique([hash(w) for w in windows], return_counts=True), strict=True) if n > 1}
        covered = {i + k for i, w in enumerate(windows) if hash(w) in many for k in range(8)}
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert quality_rules.keep_good(empty).count() == quality_rules.quality(empty).count() == 0


@pytest.mark.parametrize("module, query", [(topk, topk.op5_topk), (quality_rules, quality_rules.op7_quality_rules)])
def test_queries_with_sql(spark, module, query):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = query(spark, DATA), con.sql(module.SQL)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
