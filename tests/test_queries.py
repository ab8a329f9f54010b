"""Registered queries against their SQL on DuckDB.

The default run takes one query of each kind; CUTLAKE_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

DATA = os.environ.get("CUTLAKE_DATA", "/root/testdata/sf0.001")
SAMPLE = (
    "f1_active_tracks f7_resolve_color j1_active_at j4_eval_keyframes j5_nearest_marker j12_snap_targets a1_stage_stats a6_mad_outliers "
    "a14_peak_overlap w5_repair_dts t1_frame_manifest t4_reorder_tracks o2_interval_subtract d6_parse_timecode d8_frame_grid e2_insert_overwrite "
    "e6_split_clips e8_ripple_insert s1_read_projects_clips s7_snapshot_sink n1_image_sequences u2_mix_timeline p4_convert_color p13_composite r1_sync_monitor "
    "s1_read_projects_fields s2_write_projects_orphans j3_overlap_join j11_link_groups e8_ripple_insert_keyframes p16_custom_line_effect r2_drift_against_baseline"
).split()
NAMES = [n for n in entry.oracle_sql() if os.environ.get("CUTLAKE_ALL") or n in SAMPLE]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in order]) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_image_sequences_with_longer_numbers(spark, tmp_path):
    rows = [(1, n) for n in (99_998, 99_999, 100_000, 100_001, 123_456, 123_457)] + [(2, 7)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry.queries()["n1_image_sequences"](spark, str(tmp_path)).select("folder", "pad", "first_frame", "last_frame", "missing_before")
    want = [("/render/1/", 5, 99_998, 99_999, 0), ("/render/1/", 6, 100_000, 100_001, 0), ("/render/1/", 6, 123_456, 123_457, 23_454), ("/render/2/", 5, 7, 7, 0)]
    assert sorted(map(tuple, got.collect())) == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rel = c.sql(entry.oracle_sql()["n1_image_sequences"])
    assert sorted(rel.select("folder", "pad", "first_frame", "last_frame", "missing_before").fetchall()) == want


def test_flagship_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "pts", "clip_id", "source_id", "layer_order", "source_pts", "z"]
    assert df.count() > 0
