"""Media-timeline tables as projections of the given parquet tables.

Each table is one select list used twice: as Spark expressions and, with a few
functions respelled, as the SQL view the results are compared with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# name -> (source, lateral element count or None, [(column, expression)], filter)
# Tokens: IDIV integer division; DAYS(x) days since 1992-01-01; MICROS(x) epoch
# microseconds; ELEM(i) the i-th (0-based) element of embedding.
EPOCH = 1704067200000000

_TABLES: dict[str, tuple[str, int | None, list[tuple[str, str]], str | None]] = {
    # Clips spread over long, sparse timelines: range joins and statistics.
    "clips": (
        "orders",
        None,
        [
            ("project_id", "o_custkey IDIV 75"),
            ("clip_id", "o_orderkey"),
            ("track_id", "cast(o_orderkey % 5 as int)"),
            ("source_id", "o_orderkey % 200"),
            ("pts_in", "DAYS(o_orderdate)*90000 + (o_orderkey % 97)*901"),
            (
                "pts_out",
                "DAYS(o_orderdate)*90000 + (o_orderkey % 97)*901 + 90090"
                " + cast(floor(o_totalprice) as bigint) % 2000000",
            ),
            ("source_in", "(o_orderkey % 50)*3000"),
            (
                "kind",
                "case when o_orderkey % 5 = 4 then 'Audio' when o_orderkey % 11 = 0 then 'Image'"
                " when o_orderkey % 13 = 0 then 'Text' else 'Video' end",
            ),
            ("layer_order", "cast((o_orderkey % 5)*256 + (o_orderkey IDIV 5) % 256 as int)"),
            ("opacity", "(o_orderkey % 11)/10e0"),
            ("volume", "(o_orderkey % 7)/4e0"),
            ("pan", "(o_orderkey % 9 - 4)/4e0"),
            ("audio_muted", "o_orderkey % 17 = 0"),
            ("fade_in_pts", "(o_orderkey % 4)*9000"),
            ("fade_out_pts", "(o_orderkey % 3)*9000"),
            ("speed", "case o_orderkey % 4 when 0 then 0.5e0 when 3 then 2e0 else 1e0 end"),
        ],
        None,
    ),
    # Clips laid edge to edge on five tracks per project: edits. Tracks 0 and 1
    # carry linked material (same source, same start).
    "strip": (
        "orders",
        None,
        [
            ("project_id", "o_orderkey IDIV 500"),
            ("clip_id", "o_orderkey"),
            ("track_id", "cast(o_orderkey % 5 as int)"),
            ("source_id", "(o_orderkey IDIV 5) % 40 + ((o_orderkey % 5) IDIV 2)*1000"),
            ("pts_in", "((o_orderkey % 500) IDIV 5)*90000"),
            (
                "pts_out",
                "((o_orderkey % 500) IDIV 5)*90000 + 90000"
                " - (case when o_custkey % 7 = 0 then 9000 else 0 end)",
            ),
            ("source_in", "(o_orderkey % 50)*3000"),
            ("kind", "case when o_orderkey % 5 = 4 then 'Audio' else 'Video' end"),
            ("layer_order", "cast((o_orderkey % 5)*256 + (o_orderkey % 500) IDIV 5 as int)"),
            ("opacity", "(o_orderkey % 11)/10e0"),
            ("volume", "(o_orderkey % 7)/4e0"),
            ("pan", "(o_orderkey % 9 - 4)/4e0"),
            ("audio_muted", "o_orderkey % 17 = 0"),
            ("fade_in_pts", "(o_orderkey % 4)*9000"),
            ("fade_out_pts", "(o_orderkey % 3)*9000"),
            ("speed", "case o_custkey % 4 when 0 then 0.5e0 when 3 then 2e0 else 1e0 end"),
        ],
        None,
    ),
    "keyframes": (
        "events",
        None,
        [
            ("project_id", "user_id IDIV 8"),
            ("clip_id", "user_id"),
            (
                "param",
                "case event_type when 'click' then 'Opacity' when 'view' then 'PositionX'"
                " when 'purchase' then 'Scale' when 'signup' then 'Volume' else 'Rotation' end",
            ),
            ("pts", f"(MICROS(ts) - {EPOCH})*9 IDIV 100"),
            ("value", "value"),
            ("interp", "case when event_id % 4 = 0 then 'Hold' else 'Linear' end"),
        ],
        None,
    ),
    # Keyframes of the strip clips, in timeline time of those clips.
    "strip_keyframes": (
        "lineitem",
        None,
        [
            ("project_id", "l_orderkey IDIV 500"),
            ("clip_id", "l_orderkey"),
            ("param", "case when l_linenumber % 2 = 0 then 'Opacity' else 'PositionX' end"),
            ("pts", "((l_orderkey % 500) IDIV 5)*90000 + (l_partkey % 91)*1000"),
            ("value", "l_quantity"),
            ("interp", "case when l_returnflag = 'A' then 'Hold' else 'Linear' end"),
        ],
        None,
    ),
    "markers": (
        "events",
        None,
        [
            ("project_id", "user_id IDIV 8"),
            ("marker_id", "event_id"),
            ("pts", f"(MICROS(ts) - {EPOCH})*9 IDIV 3000000"),
            (
                "duration_pts",
                "case when event_id % 3 = 0 then cast(floor(value*100) as bigint) end",
            ),
            ("name", "event_type"),
        ],
        None,
    ),
    "av_samples": (
        "events",
        None,
        [
            ("session_id", "user_id"),
            ("ts", "ts"),
            ("video_pts", f"(MICROS(ts) - {EPOCH})*9 IDIV 100"),
            (
                "audio_pts",
                f"(MICROS(ts) - {EPOCH})*9 IDIV 100 - (cast(floor(value*100) as bigint) - 5000)",
            ),
        ],
        None,
    ),
    "pixels": (
        "embeddings",
        21,
        [
            ("frame_id", "vec_id"),
            ("x", "cast(i % 7 as int)"),
            ("y", "cast(i IDIV 7 as int)"),
            ("r", "round(abs(cast(ELEM(3*i) as double))*2, 6)"),
            ("g", "round(abs(cast(ELEM(3*i+1) as double))*2, 6)"),
            ("b", "round(abs(cast(ELEM(3*i+2) as double))*2, 6)"),
            ("a", "1e0 - (i % 4)/8e0"),
        ],
        None,
    ),
    "samples": (
        "embeddings",
        64,
        [
            ("source_id", "vec_id"),
            ("sample_idx", "cast(i as bigint)"),
            ("left", "round(cast(ELEM(i) as double)*4, 6)"),
            ("right", "round(cast(ELEM(63-i) as double)*4, 6)"),
        ],
        None,
    ),
    "packets": (
        "lineitem",
        None,
        [
            ("source_id", "l_partkey"),
            ("seq", "l_orderkey*8 + l_linenumber"),
            ("pts", "DAYS(l_shipdate)*3003"),
            ("is_key", "case when l_returnflag = 'R' then 1 else 0 end"),
        ],
        None,
    ),
    "frame_stages": (
        "lineitem",
        None,
        [
            ("run_id", "l_suppkey"),
            ("frame_index", "l_orderkey"),
            (
                "stage",
                "case l_linenumber when 1 then 'Decode' when 2 then 'Upload'"
                " when 3 then 'UploadSubmit' when 4 then 'Composite' when 5 then 'GpuTransfer'"
                " when 6 then 'UploadPrepare' else 'Mux' end",
            ),
            ("clock", "case when l_linestatus = 'F' then 'cpu' else 'gpu' end"),
            ("us", "cast(floor(l_quantity*100) as bigint)"),
        ],
        None,
    ),
    "frame_latency": (
        "events",
        None,
        [
            ("run_id", "user_id IDIV 16"),
            ("frame_index", "event_id"),
            ("latency_ms", "case when event_id % 29 <> 0 then value end"),
        ],
        None,
    ),
    "sources": (
        "part",
        None,
        [
            ("source_id", "p_partkey"),
            (
                "path",
                "concat('/media/', p_brand, '/', p_name, '_', lpad(cast(p_partkey as string), 5, '0'),"
                " case p_size % 8 when 0 then '.MP4' when 1 then '.wav' when 2 then '.png'"
                " when 3 then '.mov' when 4 then '.tif' when 5 then '.flac' when 6 then '.bin'"
                " else '.jpeg' end)",
            ),
            (
                "status",
                "case p_partkey % 5 when 0 then 'Missing' when 1 then 'Corrupted' else 'Available' end",
            ),
            ("proxy_id", "case when p_partkey % 3 = 0 then p_partkey + 100000 end"),
            ("width", "case p_size % 4 when 0 then 3840 when 1 then 1920 when 2 then 1279 else 640 end"),
            ("height", "case p_size % 4 when 0 then 2160 when 1 then 1080 when 2 then 719 else 480 end"),
            (
                "pixel_fmt",
                "case p_size % 12 when 0 then 'Yuv420p' when 1 then 'Yuv422p' when 2 then 'Yuv444p'"
                " when 3 then 'Nv12' when 4 then 'P010' when 5 then 'Yuv420p10' when 6 then 'Yuv422p10'"
                " when 7 then 'Yuv444p10' when 8 then 'Yuv420p12' when 9 then 'Yuv444p12'"
                " when 10 then 'Rgba8' else 'Rgba16f' end",
            ),
            ("fps_num", "case p_size % 3 when 0 then 30000 when 1 then 25 else 24000 end"),
            ("fps_den", "case p_size % 3 when 1 then 1 else 1001 end"),
            ("matrix_raw", "cast(p_partkey % 11 as int)"),
            ("range_raw", "cast(p_partkey % 3 as int)"),
            ("trc_raw", "cast(p_partkey % 20 as int)"),
            ("pri_raw", "cast(p_partkey % 10 as int)"),
            ("bit_depth", "cast(case p_partkey % 3 when 0 then 0 when 1 then 8 else 10 end as int)"),
            ("has_audio", "p_partkey % 4 <> 1"),
        ],
        None,
    ),
    # One job per customer.
    "jobs": (
        "customer",
        None,
        [
            ("job_id", "c_custkey"),
            ("project_id", "c_custkey IDIV 75"),
            ("pts_in", "c_custkey * 9000 - 4500"),
            (
                "pts_out",
                "c_custkey * 9000 - 4500 + cast(floor(abs(c_acctbal)*10) as bigint) * 7"
                " - (case when c_custkey % 50 = 7 then 10000000 else 0 end)",
            ),
            (
                "fps_num",
                "cast(case c_custkey % 10 when 0 then 24000 when 1 then 24 when 2 then 25 when 3 then 30000"
                " when 4 then 30 when 5 then 50 when 6 then 60000 when 7 then 60 when 8 then 120"
                " else 0 end as bigint)",
            ),
            ("fps_den", "cast(case when c_custkey % 10 in (0, 3, 6) then 1001 else 1 end as bigint)"),
            ("width", "case when c_custkey % 23 = 0 then 0 else 1920 end"),
            ("height", "1080"),
            ("threads", "cast(c_custkey % 9 as bigint)"),
            (
                "codec",
                "case c_nationkey % 5 when 0 then 'H264' when 1 then 'H265' when 2 then 'ProRes'"
                " when 3 then 'Vp9' else 'Av1' end",
            ),
            ("quality", "case when c_nationkey % 2 = 0 then 'Crf' else 'Bitrate' end"),
            ("transfer", "case c_nationkey % 3 when 0 then 'Pq' when 1 then 'Hlg' else 'Bt709' end"),
            ("output_dir", "concat('/out/', c_mktsegment)"),
        ],
        None,
    ),
}


def _spell(expr: str, engine: str) -> str:
    if engine == "spark":
        expr = expr.replace("IDIV", "div")
        expr = re.sub(r"DAYS\((\w+)\)", r"cast(datediff(\1, date'1992-01-01') as bigint)", expr)
        expr = re.sub(r"MICROS\((\w+)\)", r"unix_micros(cast(\1 as timestamp))", expr)
        return re.sub(r"ELEM\(([^)]*)\)", r"embedding[cast(\1 as int)]", expr)
    expr = expr.replace("IDIV", "//")
    expr = re.sub(
        r"DAYS\((\w+)\)", r"date_diff('day', date '1992-01-01', cast(\1 as date))", expr
    )
    expr = re.sub(r"MICROS\((\w+)\)", r"epoch_us(\1)", expr)
    return re.sub(r"ELEM\(([^)]*)\)", r"embedding[cast(\1 as int)+1]", expr)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; only a narrow projection of its source."""
    source, count, columns, where = _TABLES[name]
    df = parquet(spark, sf_dir, source)
    if count is not None:
        df = df.selectExpr("*", f"explode(sequence(0, {count - 1})) as i")
    df = df.selectExpr(*[f"{_spell(e, 'spark')} as {c}" for c, e in columns])
    return df.where(_spell(where, "spark")) if where else df


def view_sql(name: str) -> str:
    """The same table as a SELECT over the driver's views."""
    source, count, columns, where = _TABLES[name]
    cols = ", ".join(f'{_spell(e, "sql")} AS "{c}"' for c, e in columns)
    frm = source
    if count is not None:
        frm = f"(SELECT *, unnest(range({count})) AS i FROM {source})"
    sql = f"SELECT {cols} FROM {frm}"
    return f"{sql} WHERE {_spell(where, 'sql')}" if where else sql


def with_views(names: str, body: str, extra: str = "") -> str:
    """``WITH`` the named derived tables (and extra CTEs) in front of a query body."""
    parts = [f"{n} AS ({view_sql(n)})" for n in names.split()]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}"
