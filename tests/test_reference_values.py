"""Published and hand-checked values."""

import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutlake.functions import colour as cx
from cutlake.operators import pixels, timejobs
from cutlake.session import scratch_dir
from cutlake.sources import frames, luts, projects
from cutlake.streaming import monitors


def test_ciede2000_published_pairs(spark):
    # Pairs from the CIEDE2000 implementation notes of Sharma, Wu and Dalal.
    pairs = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
        (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
        (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
        (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
        (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
        (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
        (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
        (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
    ]
    df = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in pixels.lab_difference(df).collect():
        assert r.delta_e == pytest.approx(r.want, abs=1e-4)


def test_transfer_curves(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    out = df.select(
        "x", cx.nits_to_pq(cx.pq_to_nits(F.col("x"))).alias("pq"), cx.linear_to_hlg(cx.hlg_to_linear(F.col("x"))).alias("hlg"),
        cx.linear_to_srgb(cx.srgb_to_linear(F.col("x"))).alias("srgb"), cx.pq_to_nits(F.col("x")).alias("nits"),
    ).collect()
    for r in out:
        assert r.pq == pytest.approx(r.x, abs=1e-6)
        assert r.hlg == pytest.approx(r.x, abs=1e-5)
        assert r.srgb == pytest.approx(r.x, abs=1e-6)
    assert out[0].nits == 0 and out[100].nits == pytest.approx(10000)


def test_blend_modes(spark):
    row = spark.range(1).select(
        *[cx.blend_channel(F.lit(m), F.lit(0.6), F.lit(0.4)).alias(m) for m in cx.BLENDS]
    ).first()
    want = {
        "Normal": 0.6, "Add": 1.0, "Multiply": 0.24, "Screen": 0.76, "Overlay": 0.48, "Darken": 0.4, "Lighten": 0.6,
        "ColorDodge": 1.0, "ColorBurn": 0.0, "HardLight": 0.52, "SoftLight": 0.448, "Difference": 0.2, "Exclusion": 0.52,
    }
    for mode, v in want.items():
        assert row[mode] == pytest.approx(v, abs=1e-9), mode


def test_timecode_cases(spark):
    rates = spark.createDataFrame([(0, 30, 1), (1, 30000, 1001), (2, 60000, 1001), (3, 0, 1)], "r int, num bigint, den bigint")
    tcs = [
        (0, "01:00:00:00"), (1, "00:10:00;02"), (1, "00:01:00;02"), (2, "00:00:01;00"), (0, "01:23:45"), (0, "01:23:45:123"),
        (0, "01:75:45:12"), (0, "aa:00:00:00"), (3, "00:00:00:00"), (0, " 00:00:01:15 "),
    ]
    ok, bad = timejobs.parse_timecode(spark.createDataFrame(tcs, "r int, tc string"), rates, "r")
    assert {(x.r, x.tc): (x.frame, x.pts) for x in ok.collect()} == {
        (0, "01:00:00:00"): (108000, 324000000), (1, "00:10:00;02"): (17984, 54005952), (1, "00:01:00;02"): (1800, 5405400),
        (2, "00:00:01;00"): (60, 90090), (0, " 00:00:01:15 "): (45, 135000),
    }
    assert {(x.tc, x.error) for x in bad.collect()} == {
        ("01:23:45", "InvalidFormat"), ("01:23:45:123", "InvalidFormat"), ("01:75:45:12", "InvalidComponents"),
        ("aa:00:00:00", "InvalidComponents"), ("00:00:00:00", "InvalidRate"),
    }
    back, _ = timejobs.format_timecode(ok.select("r", "pts"), rates, "r")
    assert {x.tc for x in back.collect()} >= {"01:00:00:00", "00:10:00;02", "00:01:00;02", "00:00:01:15"}


@pytest.mark.parametrize("num,den", [(24, 1), (25, 1), (30, 1), (60, 1), (120, 1), (24000, 1001), (30000, 1001), (60000, 1001)])
def test_grid_covers_ten_seconds(spark, num, den):
    job = spark.createDataFrame([(1, 500, 900500, num, den)], "job_id int, pts_in bigint, pts_out bigint, fps_num bigint, fps_den bigint")
    pts = [r.pts for r in timejobs.frame_grid(job).orderBy("frame").collect()]
    assert pts[0] == 500 and len(pts) == math.ceil(10 * num / den)
    step = round(90000 * den / num)
    assert all(abs(b - a - step) <= 1 for a, b in zip(pts, pts[1:]))
    assert 0 <= 900500 - pts[-1] <= step + 1


@pytest.mark.parametrize("matrix", ["Bt601", "Bt709", "Bt2020"])
@pytest.mark.parametrize("rng", ["Full", "Limited"])
def test_yuv_round_trip(spark, matrix, rng):
    px = spark.createDataFrame([(0, x, 0, x / 4, 1 - x / 4, x / 8, 1.0) for x in range(4)], "frame_id int, x int, y int, r double, g double, b double, a double")
    prof = spark.createDataFrame([(0, matrix, rng, 8, True, 4, 1)], "frame_id int, matrix string, range string, bit_depth int, semi_planar boolean, chroma_w int, chroma_h int")
    yuv = pixels.rgb_to_yuv(px, prof)
    # Full-size chroma: spread x so that each pixel reads its own sample.
    luma = yuv.select("frame_id", (F.col("x") * 2).alias("x"), "y", F.col("yy").alias("v"))
    chroma = yuv.select("frame_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "cb", "cr")
    got = {r.x // 2: r for r in pixels.yuv_to_rgb(luma, chroma, prof).collect()}
    for r in px.collect():
        assert [got[r.x][c] for c in "rgb"] == pytest.approx([r.r, r.g, r.b], abs=1e-9)


def _document(**over):
    doc = {
        "format_version": 1, "name": "A", "settings": {"width": 1, "height": 2, "frame_rate": {"num": 30, "den": 1}, "timebase": {"num": 1, "den": 90000}},
        "tracks": {"tracks": [{"id": 0, "kind": "Video", "name": "V", "mute": False, "solo": False, "locked": False},
                              {"id": 1, "kind": {"Audio": {"sample_rate": 48000, "channels": 2}}, "name": "A", "mute": True, "solo": False, "locked": False, "gain": 0.5}]},
        "clips": {"ids": [4, 5], "track_ids": [0, 1], "source_ids": [1, 1], "pts_in": [0, 10], "pts_out": [10, 20], "source_in": [0, 0], "layer_order": [0, 1], "opacity": [1, 0.5],
                  "volume": [1, 1], "pan": [0, 0], "audio_muted": [False, True], "speed": [1, 2], "pitch": [0, 0], "kind": ["Image", {"Text": {"text": "hi", "font_size": 3}}]},
        "sources": {"ids": [1], "paths": ["/m.mov"], "proxy_ids": [None]},
    }
    doc.update(over)
    return doc


def test_project_documents(spark):
    folder = scratch_dir(spark, "docs")
    old = _document(name="Old")
    del old["clips"]["kind"]
    texts = [json.dumps(_document(), indent=1), json.dumps(old), json.dumps(_document(format_version=2)), json.dumps(_document())[:200]]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(4).write.option("maxRecordsPerFile", 1).text(folder)
    t = projects.read_projects(spark, folder)
    assert sorted(r.reason for r in t["rejects"].collect()) == ["NewerFormat", "Unreadable"]
    assert sorted(r.name for r in t["projects"].collect()) == ["A", "Old"]
    kinds = sorted((r.kind, r.fade_in_pts, r.speed) for r in t["clips"].collect())
    assert kinds == [("Image", 0, 1.0), ("Text", 0, 2.0), ("Video", 0, 1.0), ("Video", 0, 2.0)]
    assert sorted((r.track_id, r.kind, r.gain) for r in t["tracks"].collect()) == [(0, "Video", 1.0)] * 2 + [(1, "Audio", 0.5)] * 2
    assert t["sources"].count() == 2 and t["keyframes"].count() == 0


def test_cube_rejects(spark):
    folder = scratch_dir(spark, "cubes")
    ok = "LUT_3D_SIZE 2\n" + "\n".join("0 0 1" for _ in range(8))
    texts = [ok, ok + "\n1 1 1", ok.replace("LUT_3D_SIZE 2\n", ""), ok.replace("0 0 1", "0 x 1", 1), "LUT_3D_SIZE two\n", "DOMAIN_MIN 0 0\n" + ok]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(6).write.option("maxRecordsPerFile", 1).text(folder)
    good, bad = luts.read_luts(spark, folder)
    assert good.count() == 8
    assert sorted(r.reason for r in bad.collect()) == ["DataCountMismatch", "InvalidHeader", "InvalidHeader", "MissingSize", "ParseError"]


def test_frame_csv_rejects_short_rows(spark):
    folder = scratch_dir(spark, "csv")
    header = ",".join(["frame", *frames.FRAME_COLUMNS])
    lines = [header, "1" + "," * 12, "2,1.5" + "," * 11, "3,1.5", "4,x" + "," * 11]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    ok, bad = frames.read_frame_csv(spark, folder)
    assert sorted((r.frame, r.latency_ms) for r in ok.collect()) == [(1, None), (2, 1.5)]
    assert sorted(r.line[0] for r in bad.collect()) == ["3", "4"]


def _run(spark, stream, name):
    out = scratch_dir(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def _feed(spark, rows, schema, name):
    folder = scratch_dir(spark, name)
    for batch in rows:  # one file per batch, in order
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_millis("ts")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_progress_goes_stale_and_ends(spark):
    monitors.use_state_store(spark)
    s = 1000
    schema = "job_id bigint, ts bigint, frames_done bigint, total_frames bigint, elapsed_s double, phase string"
    rows = [
        [(1, 10 * s, 50, 100, 5.0, "Rendering"), (2, 10 * s, 3, 100, 1.0, "Rendering")],
        [(2, 20 * s, 100, 100, 20.0, "Done")],
        [(3, 500 * s, 1, 10, 1.0, "Rendering")],
        [(3, 501 * s, 2, 10, 1.0, "Done")],
    ]
    out = _run(spark, monitors.progress_monitor(_feed(spark, rows, schema, "pf"), stall_s=60, delay="1 second"), "po")
    seen = {(r.job_id, r.ts_ms // s, r.status): r for r in out}
    assert seen[(1, 10, "Rendering")].eta_s == pytest.approx(5.0)
    assert seen[(2, 10, "Rendering")].eta_s is None
    assert (1, 10, "Stalled") in seen and (2, 20, "Done") in seen
    assert not any(k[0] == 2 and k[2] == "Stalled" for k in seen)


def test_progress_sends_only_the_newest_rows(spark):
    rows = [(j % 5, t % 90, j) for j, t in enumerate(range(0, 9000, 7))] + [(7, 3, -1), (7, 3, -2), (8, None, 0)]
    batch = pa.RecordBatch.from_pylist([{"job_id": j, "ts": None if t is None else t * 1000, "frames_done": n} for j, t, n in rows])
    want = {}
    for j, t, n in rows:
        if j not in want or (t or -1) > (want[j][0] or -1):
            want[j] = (t, n)
    got = [r for b in monitors._newest(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert {r["job_id"]: (None if r["ts"] is None else r["ts"] // 1000, r["frames_done"]) for r in got} == want and len(got) == len(want)


def test_debounce_keeps_the_newest(spark):
    monitors.use_state_store(spark)
    s = 1000
    # From second 100 on: a stamp at the initial watermark, the epoch, would be late.
    rows = [
        [("/a", 100 * s, "v0"), ("/a", 105 * s, "v1")], [("/a", 129 * s, "v2"), ("/a", 131 * s, "v3")],
        [("/z", 500 * s, "z")], [("/z", 501 * s, "z2")],
    ]
    stream = _feed(spark, rows, "path string, ts bigint, json string", "df")
    out = _run(spark, monitors.debounced_snapshots(stream, wait_s=30, delay="1 second"), "do")
    assert [(r.path, r.json) for r in sorted(out, key=lambda r: r.version_ts)] == [("/a", "v2"), ("/a", "v3")]


def test_dts_repair_carries_over_batches(spark):
    monitors.use_state_store(spark)
    rows = [[(1, 0, 1, 5), (1, 0, 2, 5)], [(1, 0, 3, 4), (1, 0, 4, 20)]]
    stream = _feed(spark, rows, "stream_id bigint, ts bigint, seq bigint, dts bigint", "rf").drop("ts")
    out = _run(spark, monitors.repair_dts_stream(stream), "ro")
    assert sorted((r.seq, r.dts) for r in out) == [(1, 5), (2, 6), (3, 7), (4, 20)]
