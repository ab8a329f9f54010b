"""The skew-proof helpers against plain pandas, with cells small enough to split everything."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cutlake.operators.asof import asof_neighbours
from cutlake.operators.quantiles import median_of, nearest_rank, order_statistics, upper_median_rank
from cutlake.operators import rangejoin
from cutlake.operators.rangejoin import overlapping_intervals, points_in_intervals
from cutlake.operators.scan import Scan, chunked_scan, ranked
from cutlake.operators.timejobs import frame_grid
from cutlake.operators.stats import node_frame_totals, node_timings
from cutlake.operators.windows import grid_uniform, repair_dts
from cutlake.plans import load
from cutlake.plans.registry import Lib


@pytest.mark.parametrize("cell", [1, 7, 64, 1 << 20])
def test_chunked_scan_equals_one_window(spark, cell):
    rng = random.Random(cell)
    rows = [(k, t, rng.choice([None, rng.randint(-50, 50)])) for k in (1, 2) for t in rng.sample(range(-200, 400), 90)]
    df = spark.createDataFrame(rows, "k int, t bigint, v int")
    scans = [
        Scan("s", "sum", F.col("v")), Scan("sx", "sum", F.col("v"), inclusive=False),
        Scan("m", "max", F.col("v"), inclusive=False), Scan("p", "last", F.col("v"), inclusive=False),
        Scan("n", "first", F.col("v"), inclusive=False),
    ]
    got = chunked_scan(df, ["k"], "t", scans, cell).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for _, g in got.groupby("k"):
        v = g["v"].tolist()
        for i, row in enumerate(g.itertuples()):
            before = [x for x in v[:i] if x == x and x is not None]
            upto = [x for x in v[: i + 1] if x == x and x is not None]
            after = [x for x in v[i + 1 :] if x == x and x is not None]
            want = {
                "s": sum(upto) if upto else None, "sx": sum(before) if before else None,
                "m": max(before) if before else None, "p": before[-1] if before else None, "n": after[0] if after else None,
            }
            for name, w in want.items():
                x = getattr(row, name)
                assert (w is None and (x is None or x != x)) or x == w


@pytest.mark.parametrize("cell", [1, 5, 1 << 21])
def test_ranked_with_hot_ties(spark, cell):
    rows = [(1, random.Random(i).choice([0, 0, 0, 3, 9]), i) for i in range(300)]
    got = ranked(spark.createDataFrame(rows, "k int, t bigint, id bigint"), ["k"], "t", "id", "r", cell).collect()
    want = {row: n for n, row in enumerate(sorted(rows), 1)}
    assert {(g.k, g.t, g.id): g.r for g in got} == want


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(1)
    frames = []
    for key, values in enumerate(
        [rng.normal(0, 50, 501), np.full(40, 3.25), rng.integers(0, 5, 200) * 1.0, 5 + rng.random(300) * 1e-9, [7.5]]
    ):
        frames.append(pd.DataFrame({"k": key, "v": values}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).unionByName(spark.sql("select 0L k, cast(null as double) v"))
    got = order_statistics(
        df, ["k"], "v", {"p95": nearest_rank(0.95), "p99": nearest_rank(0.99), "med": upper_median_rank()}
    ).collect()
    med = {r.k: r.median for r in median_of(df, ["k"], "v").collect()}
    assert len(got) == 5
    for g in got:
        v = np.sort(pdf[pdf.k == g.k].v.to_numpy())
        n = len(v)
        assert g.n == n
        assert g.p95 == v[max(math.ceil(n * 0.95), 1) - 1]
        assert g.p99 == v[max(math.ceil(n * 0.99), 1) - 1]
        assert g.med == v[n // 2]
        assert med[g.k] == (v[(n + 1) // 2 - 1] + v[n // 2]) / 2


def _spans(rng, n):
    out = []
    for i in range(n):
        lo = rng.randint(-300, 900)
        out.append((rng.randint(0, 1), i, lo, lo + rng.choice([0, 1, 5, 60, 700])))
    return out


@pytest.mark.parametrize("width,long_width", [(16, None), (3, None), (1 << 19, None), (2, 64)])
def test_range_joins_match_brute_force(spark, width, long_width):
    rng = random.Random(width)
    spans, points = _spans(rng, 80), [(rng.randint(0, 1), i, rng.randint(-310, 950)) for i in range(120)]
    iv = spark.createDataFrame(spans, "k int, id int, lo bigint, hi bigint")
    pt = spark.createDataFrame(points, "k int, pid int, t bigint")
    got = points_in_intervals(pt, iv, ["k"], "t", "lo", "hi", width=width, long_width=long_width)
    want = sorted((p, i) for k, p, t in points for k2, i, lo, hi in spans if k == k2 and lo <= t < hi)
    assert sorted((r.pid, r.id) for r in got.collect()) == want

    other = iv.select("k", F.col("id").alias("id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = overlapping_intervals(iv, other, ["k"], ("lo", "hi"), ("lo2", "hi2"), width=width)
    want = sorted(
        (a, b) for k, a, lo, hi in spans for k2, b, lo2, hi2 in spans
        if k == k2 and lo < hi and lo2 < hi2 and lo < hi2 and lo2 < hi
    )
    assert sorted((r.id, r.id2) for r in pairs.collect()) == want


@pytest.mark.parametrize("width", [1, 16, 1000, 1 << 19, 1 << 40])
def test_intervals_of_every_length(spark, width):
    """From one tick to half the axis: few buckets each, two if long, and the same pairs as brute force."""
    rng = random.Random(width)
    spans = [(0, i, lo, lo + (1 << e) + d) for i, (e, d) in enumerate((e, d) for e in range(0, 61, 3) for d in (-1, 0, 1)) for lo in [rng.randint(-(1 << 60), 1 << 60)]]
    spans += [(0, 900, -5, 1 << 36), (0, 901, 7, 7), (0, 902, 9, 3), (1, 903, 0, 1 << 36), (0, 904, 0, 1 << 62)]
    spans += [(0, 905, None, 5), (0, 906, 5, None)]
    good = [s for s in spans if None not in s[2:] and s[2] < s[3]]
    points = [(0, i, t) for i, t in enumerate(x for s in good[:40] for x in (s[2], s[3], s[3] - 1))] + [(1, 901, 5)]
    iv = spark.createDataFrame(spans, "k int, id int, lo bigint, hi bigint")
    level = rangejoin._class(F.col("lo"), F.col("hi"), width)
    cells = iv.where("lo < hi").select("lo", "hi", F.size(rangejoin._cells(F.col("lo"), F.col("hi"), level, width)).alias("n"))
    assert cells.where(f"hi - lo <= {8 * width}").agg(F.max("n")).first()[0] <= 9
    assert (cells.where(f"hi - lo > {8 * width} AND hi - lo <= {1 << 50}").agg(F.max("n")).first()[0] or 0) <= 2
    # There is no class beyond 2^59 ticks.
    assert cells.agg(F.max("n")).first()[0] <= 9
    got = points_in_intervals(spark.createDataFrame(points, "k int, pid int, t bigint"), iv, ["k"], "t", "lo", "hi", width=width)
    want = sorted((p, i) for k, p, t in points for k2, i, lo, hi in good if k == k2 and lo <= t < hi)
    assert sorted((r.pid, r.id) for r in got.collect()) == want
    other = iv.where("id % 2 = 0").select("k", F.col("id").alias("id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = overlapping_intervals(iv, other, ["k"], ("lo", "hi"), ("lo2", "hi2"), width=width)
    want = sorted((a, b) for k, a, lo, hi in good for k2, b, lo2, hi2 in good if b % 2 == 0 and k == k2 and lo < hi2 and lo2 < hi)
    assert sorted((r.id, r.id2) for r in pairs.collect()) == want


@pytest.mark.parametrize("strict", [False, True])
def test_asof_neighbours(spark, strict):
    rng = random.Random(3)
    events = [(rng.randint(0, 1), t, t * 10) for t in rng.sample(range(100), 25)]
    points = [(rng.randint(0, 2), rng.randint(-5, 105)) for _ in range(60)]
    e = spark.createDataFrame(events, "k int, et bigint, v bigint")
    p = spark.createDataFrame(points, "k int, t bigint")
    got = asof_neighbours(p, e, ["k"], "t", "et", ["v"], sides=("prev", "next"), strict=strict, cell=8).collect()
    assert len(got) == len(points)
    for r in got:
        mine = [t for k, t, _ in events if k == r.k]
        before = [t for t in mine if t < r.t or (t == r.t and not strict)]
        after = [t for t in mine if t > r.t or (t == r.t and not strict)]
        assert (r.prev.et if r.prev else None) == (max(before) if before else None)
        assert (r.next.et if r.next else None) == (min(after) if after else None)


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("long_width", [None, 1 << 10])
def test_an_exploded_side_is_not_broadcast(spark, long_width):
    points = spark.range(4).select(F.col("id").alias("k"), F.explode(F.expr("sequence(0L, 999L)")).alias("t"))
    spans = spark.range(4).selectExpr("id AS k", "100L AS lo", "350L AS hi")
    hits = points_in_intervals(points, spans, ["k"], "t", "lo", "hi", width=16, long_width=long_width)
    assert hits.count() == 1000 and "Broadcast" not in _executed(hits)
    other = spans.selectExpr("k", "lo + 1 AS lo2", "hi AS hi2")
    pairs = overlapping_intervals(spans, other, ["k"], ("lo", "hi"), ("lo2", "hi2"), width=16)
    assert pairs.count() == 4 and "Broadcast" not in _executed(pairs)


def test_a_frame_grid_is_not_broadcast(spark):
    jobs = spark.range(1, 4).selectExpr(
        "id AS job_id", "0L AS pts_in", "90000L * 400 AS pts_out", "25L AS fps_num", "1L AS fps_den"
    )
    out = grid_uniform(frame_grid(jobs).select("job_id", "frame", "pts"), jobs)
    assert "SortMergeJoin" in _executed(out)
    assert sorted(map(tuple, out.collect())) == [(i, 10_000, True, True, True) for i in (1, 2, 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [1, 7, 1 << 21])
def test_repaired_stamps_take_one_scan(spark, cell):
    rng = random.Random(cell)
    rows = [(k, q, rng.choice([None, *range(40)])) for k in (1, 2) for q in rng.sample(range(-50, 200), 60)]
    packets = spark.createDataFrame(rows, "stream_id bigint, seq bigint, dts bigint")
    out = repair_dts(packets, cell)
    want = {}
    for k in (1, 2):
        top = None
        for i, (_, q, dts) in enumerate(sorted(r for r in rows if r[0] == k)):
            top = max([x for x in (top, None if dts is None else dts - i) if x is not None], default=None)
            want[k, q] = None if top is None else top + i
    assert {(r.stream_id, r.seq): r.dts for r in out.collect()} == want
    # Rows, summaries by stream, and the join back; ranking and scanning apart took more.
    assert _plan(repair_dts(packets, cell)).count("Exchange hashpartitioning") <= 4


def test_scans_and_medians_share_the_exchange_of_their_rows(spark, tmp_path):
    spark.range(2000).selectExpr("id % 7 AS k", "id AS t", "cast(id % 90 AS double) AS v").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (chunked_scan(rows, ["k"], "t", [Scan("s", "sum", F.col("v"))], 64), median_of(rows, ["k"], "v")):
            out.collect()
            assert "ReusedExchange" in _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_nodes_are_chosen_before_they_are_reported(spark):
    rng = random.Random(13)
    rows = [(r, f, q, n, rng.choice([None, 1.5, 2.25, 8.0])) for q, (r, f, n) in enumerate((r, f, n) for r in (1, 2) for f in range(9) for n in "aabbbc")]
    brackets = spark.createDataFrame([*rows, (3, 0, 999, "x", None)], "run_id bigint, frame bigint, seq bigint, node string, ms double")
    totals = {(r.run_id, r.node): r.frame_total_ms for r in node_frame_totals(brackets).collect()}
    assert totals == {(r.run_id, r.node): r.frame_total_ms for r in node_timings(brackets).collect()}
    assert "LeftSemi" in _plan(load().plans["t3_top_nodes"](Lib(spark, "/root/testdata/sf0.001")))
