"""Table jobs on exact time: rescaling, frames, timecode, grids, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions import timebase as tbx
from cutlake.functions.arith import WIDE, idiv, ratio, wide
from cutlake.operators.scan import Scan, chunked_scan, ranked

Pair = tuple[DataFrame, DataFrame]


def _with_rate(df: DataFrame, rates: DataFrame, key: str) -> Pair:
    """Rows with their rate, and rows whose rate is unknown or has a zero part."""
    joined = df.join(rates, key, "left")
    good = (F.col("num") != 0) & (F.col("den") != 0)
    ok = joined.where(good)
    return ok, joined.where(~F.coalesce(good, F.lit(False))).select(*df.columns, F.lit("InvalidRate").alias("error"))


def rescale(df: DataFrame, timebases: DataFrame, key: str, dst: tuple[int, int]) -> Pair:
    """``pts`` from each row's timebase ``(key, num, den)`` to one target timebase."""
    ok, rejects = _with_rate(df, timebases, key)
    out = tbx.rescale_ticks(F.col("pts"), F.col("num"), F.col("den"), F.lit(dst[0]), F.lit(dst[1]))
    return ok.withColumn("rescaled", out).drop("num", "den"), rejects


def to_ns(df: DataFrame, tb_den: int = tbx.TICKS_PER_SECOND) -> DataFrame:
    return df.withColumn("ns", tbx.ticks_to_ns(F.col("pts"), tb_den))


def from_ns(df: DataFrame, tb_den: int = tbx.TICKS_PER_SECOND) -> DataFrame:
    return df.withColumn("pts", tbx.ns_to_ticks(F.col("ns"), tb_den))


def frame_to_pts(df: DataFrame, rates: DataFrame, key: str, mode: str = "round") -> Pair:
    """Adds ``pts`` of each ``frame``; mode 'round' (half away) or 'truncate'."""
    fn = {"round": tbx.frame_start, "truncate": tbx.frame_start_trunc}[mode]
    ok, rejects = _with_rate(df, rates, key)
    return ok.withColumn("pts", fn(F.col("frame"), F.col("num"), F.col("den"))).drop("num", "den"), rejects


def pts_to_frame(df: DataFrame, rates: DataFrame, key: str, mode: str = "round") -> Pair:
    """Adds ``frame`` of each ``pts``; mode 'round' (half away) or 'truncate'."""
    fn = {"round": tbx.frame_at, "truncate": tbx.frame_at_trunc}[mode]
    ok, rejects = _with_rate(df, rates, key)
    return ok.withColumn("frame", fn(F.col("pts"), F.col("num"), F.col("den"))).drop("num", "den"), rejects


def source_offset(df: DataFrame) -> DataFrame:
    """Adds ``source_offset`` for ``offset`` and ``speed``, and the way back."""
    return df.withColumns(
        {
            "source_offset": tbx.source_offset(F.col("offset"), F.col("speed")),
            "timeline_offset": tbx.timeline_offset(F.col("offset"), F.col("speed")),
        }
    )


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; 92 remainder steps are enough for any 64-bit pair."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        start,
        lambda s, _: F.when(
            s["b"] != 0, F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))
        ).otherwise(s),
    )
    return step["a"]


def normalise_rates(df: DataFrame, num: str = "num", den: str = "den") -> Pair:
    """Fractions in lowest terms with the sign on the numerator; zero divisors and missing parts rejected.

    The reduction runs once per distinct fraction and is joined back.
    """
    distinct = df.select(num, den).distinct().where(F.col(den) != 0)
    g = _gcd(F.abs(F.col(num)), F.abs(F.col(den)))
    sign = F.when(F.col(den) < 0, -1).otherwise(1)
    reduced = distinct.withColumn("__g", g * sign).select(
        num, den, idiv(F.col(num), F.col("__g")).alias("n"), idiv(F.col(den), F.col("__g")).alias("d")
    )
    out = df.join(reduced, [num, den])
    error = F.when(F.col(num).isNull() | F.col(den).isNull(), "MissingPart").when(F.col(den) == 0, "ZeroDenominator")
    return out, df.withColumn("error", error).where(F.col("error").isNotNull())


_SMALLEST = -(1 << 63)
_LARGEST = (1 << 63) - 1


def _wide_gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of 38-digit integers; 183 remainder steps are enough."""
    start = F.struct(a.cast(WIDE).alias("a"), b.cast(WIDE).alias("b"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(183)),
        start,
        lambda s, _: F.when(
            s["b"] != 0, F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast(WIDE))).cast(WIDE).alias("b"))
        ).otherwise(s),
    )
    return step["a"]


def combine_rates(df: DataFrame) -> DataFrame:
    """Sum and product of ``a_num/a_den`` and ``b_num/b_den``, in lowest terms, and an ``error``.

    Only what doesn't fit 64 bits in lowest terms is NULL (error ``Overflow``), as are results
    of a missing part (``MissingPart``) or a zero below the line (``ZeroDenominator``). Terms
    are reduced crosswise before they are multiplied, and wide where they still pass 64 bits.
    """
    an, ad, bn, bd = (F.col(c) for c in ("a_num", "a_den", "b_num", "b_den"))
    missing = an.isNull() | ad.isNull() | bn.isNull() | bd.isNull()
    zero = (ad == 0) | (bd == 0)
    smallest = (an == _SMALLEST) | (ad == _SMALLEST) | (bn == _SMALLEST) | (bd == _SMALLEST)
    usable = ~(missing | zero | smallest)
    safe = [F.when(usable, p) for p in (an, ad, bn, bd)]
    size = [F.abs(p) for p in safe]
    # One struct behind an explode, so that no divisor is worked out twice.
    divisors = F.struct(_gcd(size[0], size[1]).alias("a"), _gcd(size[2], size[3]).alias("b"))
    step = df.select("*", F.explode_outer(F.array(divisors)).alias("__g"))
    low = [idiv(p, F.col(f"__g.{side}")) for p, side in zip(safe, "aabb", strict=True)]
    low = F.struct(*[p.alias(n) for p, n in zip(low, ("an", "ad", "bn", "bd"), strict=True)])
    step = step.select("*", F.explode_outer(F.array(low)).alias("__l"))
    an, ad, bn, bd = (F.col(f"__l.{c}") for c in ("an", "ad", "bn", "bd"))
    cross = F.struct(_gcd(F.abs(an), F.abs(bd)).alias("x"), _gcd(F.abs(bn), F.abs(ad)).alias("y"), _gcd(F.abs(ad), F.abs(bd)).alias("d"))
    step = step.select("*", F.explode_outer(F.array(cross)).alias("__c"))
    x, y, d = (F.col(f"__c.{c}") for c in "xyd")
    times = lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(WIDE)
    sums = F.struct(
        F.try_add(times(an, idiv(bd, d)), times(bn, idiv(ad, d))).cast(WIDE).alias("n"), times(ad, idiv(bd, d)).alias("d"),
        times(idiv(an, x), idiv(bn, y)).alias("pn"), times(idiv(ad, y), idiv(bd, x)).alias("pd"),
    )
    step = step.select("*", F.explode_outer(F.array(sums)).alias("__s"))
    small = (F.abs("__s.n") <= _LARGEST) & (F.abs("__s.d") <= _LARGEST)
    common = F.when(small, _gcd(F.abs("__s.n"), F.abs("__s.d")).cast(WIDE)).otherwise(_wide_gcd(F.abs("__s.n"), F.abs("__s.d")))
    step = step.select("*", F.explode_outer(F.array(common)).alias("__k"))
    exact = {"sum": (_quotient("__s.n", "__k"), _quotient("__s.d", "__k")), "product": (F.col("__s.pn"), F.col("__s.pd"))}
    exact = F.struct(*[part.alias(f"{name}_{at}") for name, pair in exact.items() for at, part in zip(("num", "den"), pair, strict=True)])
    step = step.select("*", F.explode_outer(F.array(exact)).alias("__e"))
    out = {}
    for name in ("sum", "product"):
        n, below = F.col(f"__e.{name}_num"), F.col(f"__e.{name}_den")
        fits = (F.abs(n) <= _LARGEST) & (F.abs(below) <= _LARGEST)
        sign = F.when(below < 0, -1).otherwise(1)
        out |= {f"{name}_{at}": F.when(fits, part).cast("bigint") * sign for at, part in (("num", n), ("den", below))}
    found = step.select(*df.columns, *[c.alias(k) for k, c in out.items()])
    lost = F.col("sum_num").isNull() | F.col("product_num").isNull()
    error = F.when(missing, "MissingPart").when(zero, "ZeroDenominator").when(smallest | lost, "Overflow")
    return found.withColumn("error", error)


def _quotient(value: str, divisor: str) -> Column:
    """64-bit quotient of 38-digit integers that divide, NULL where it doesn't fit.

    ``div`` gives 64 bits and fails beyond, so the size is known before: from doubles, and
    near the limit from the exact distance to a base just below it.
    """
    base = _LARGEST - _LARGEST % 1_000_000
    v, d = F.abs(value), F.col(divisor)
    about = v.cast("double") / F.nullif(d, F.lit(0).cast(WIDE)).cast("double")
    above = F.call_function("div", (v - (d * F.lit(base).cast("decimal(19,0)")).cast(WIDE)).cast(WIDE), d)
    q = F.when(about < 9.2e18, F.call_function("div", v, d)).when(about < 9.3e18, F.when(above <= _LARGEST - base, above + base))
    return F.when(F.col(value) < 0, -q).otherwise(q)


_TC_PART = r"(?:[0-9]{2}|\+[0-9])"
_SPACES = " \t\n\r\f\v"


def _nominal() -> Column:
    return F.round(F.col("num") / F.col("den")).cast("bigint")


def parse_timecode(df: DataFrame, rates: DataFrame, key: str) -> Pair:
    """``tc`` strings to frame number and ticks.

    ``HH:MM:SS:FF``, or ``;FF`` for drop-frame, which is only corrected at nominal
    30. Rejects: InvalidFormat, InvalidComponents, InvalidRate.
    """
    rated, no_rate = _with_rate(df, rates, key)
    tc = F.col("__tc")
    mark = F.substring(tc, 9, 1)
    shaped = (
        (F.octet_length(tc) == 11) & (F.substring(tc, 3, 1) == ":") & (F.substring(tc, 6, 1) == ":") & mark.isin(":", ";")
    )
    numeric = tc.rlike(f"^{_TC_PART}:{_TC_PART}:{_TC_PART}[:;]{_TC_PART}$")
    rated = rated.withColumn("__tc", F.btrim("tc", F.lit(_SPACES)))
    rated = rated.withColumns({"__shaped": F.coalesce(shaped, F.lit(False)), "__numeric": numeric, "__nom": _nominal()})

    def part(at: int) -> Column:
        return F.substring(tc, at, 2).try_cast("bigint")

    parsed = rated.withColumns(
        {
            "__h": part(1), "__m": part(4), "__s": part(7), "__f": part(10),
            "__drop": mark == ";",
        }
    )
    error = F.when(~F.col("__shaped"), "InvalidFormat").when(
        ~F.col("__numeric") | (F.col("__m") >= 60) | (F.col("__s") >= 60), "InvalidComponents"
    )
    parsed = parsed.withColumn("error", error)
    seconds = F.col("__h") * 3600 + F.col("__m") * 60 + F.col("__s")
    minutes = F.col("__h") * 60 + F.col("__m")
    dropped = F.when(
        F.col("__drop") & (F.col("__nom") == 30), (minutes - idiv(minutes, F.lit(10))) * 2
    ).otherwise(0)
    ok = parsed.where(F.col("error").isNull()).withColumn(
        "frame", seconds * F.col("__nom") + F.col("__f") - dropped
    )
    ok = ok.withColumn("pts", tbx.frame_start_trunc(F.col("frame"), F.col("num"), F.col("den")))
    bad = parsed.where(F.col("error").isNotNull()).select(*df.columns, "error")
    return ok.select(*df.columns, "frame", "pts"), bad.unionByName(no_rate)


def format_timecode(df: DataFrame, rates: DataFrame, key: str) -> Pair:
    """Adds ``tc`` for ``pts``. 59.94 prints the drop-frame mark but is not corrected."""
    rated, rejects = _with_rate(df, rates, key)
    num, den = F.col("num"), F.col("den")
    drop = (den == 1001) & num.isin(30000, 60000)
    frame = F.greatest(tbx.frame_at_trunc(F.col("pts"), num, den), F.lit(0))
    staged = rated.withColumns({"__n": _nominal(), "__fr": frame, "__drop": drop})
    # Drop-frame skips 2 labels a minute except every tenth minute.
    ten, one = 30 * 60 * 10 - 18, 30 * 60 - 2
    d, m = idiv(F.col("__fr"), F.lit(ten)), F.col("__fr") % ten
    skip = d * 18 + F.when(m > 2, idiv(m - 2, F.lit(one)) * 2).otherwise(0)
    shown = F.when(F.col("__drop") & (F.col("__n") == 30), F.col("__fr") + skip).otherwise(F.col("__fr"))
    staged = staged.withColumn("__fr", shown)
    total = idiv(F.col("__fr"), F.col("__n"))
    sep = F.when(F.col("__drop"), ";").otherwise(":")
    tc = F.format_string(
        "%02d:%02d:%02d%s%02d",
        idiv(total, F.lit(3600)), idiv(total, F.lit(60)) % 60, total % 60, sep, F.col("__fr") % F.col("__n"),
    )
    return staged.withColumn("tc", tc).select(*df.columns, "tc"), rejects


_BLOCK = 1 << 16


def _job_frames() -> Column:
    return tbx.frame_count(F.col("pts_in"), F.col("pts_out"), F.col("fps_num"), F.col("fps_den"))


def job_rejects(jobs: DataFrame, threads: bool = False) -> DataFrame:
    """Jobs that ``frame_grid`` (with ``threads``: ``partition_segments``) makes no rows for, with a reason."""
    needed = ["pts_in", "pts_out", "fps_num", "fps_den", *(["threads"] if threads else [])]
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(name).isNull()
    reason = (
        F.when(missing, "MissingField")
        .when((F.col("fps_num") <= 0) | (F.col("fps_den") <= 0), "InvalidRate")
        .when(F.col("pts_in") >= F.col("pts_out"), "InvalidDuration")
    )
    if threads:
        reason = reason.when(F.col("threads") <= 0, "NoThreads")
    return jobs.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _good_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("fps_num") > 0) & (F.col("fps_den") > 0) & (F.col("pts_in") < F.col("pts_out")))


def frame_grid(jobs: DataFrame) -> DataFrame:
    """Every output frame of every job with its tick; ``job_rejects`` has the jobs without.

    Frames are generated in blocks that are spread before they are expanded, so a
    very long job neither builds one huge array nor stays in one task.
    """
    n = _good_jobs(jobs).withColumn("__n", _job_frames()).where(F.col("__n") > 0)
    blocks = n.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), idiv(F.col("__n") - 1, F.lit(_BLOCK))))
    ).repartition("job_id", "__block")
    first = F.col("__block") * _BLOCK
    frames = blocks.withColumn(
        "frame", F.explode(F.sequence(first, F.least(first + (_BLOCK - 1), F.col("__n") - 1)))
    )
    start = tbx.frame_start(F.col("frame"), F.col("fps_num"), F.col("fps_den"))
    return frames.withColumn("pts", F.col("pts_in") + start).drop("__n", "__block")


def partition_segments(jobs: DataFrame) -> DataFrame:
    """Each job's frames in at most ``threads`` contiguous ranges of equal size; see ``job_rejects``."""
    n = _good_jobs(jobs).withColumn("__n", _job_frames()).where((F.col("__n") > 0) & (F.col("threads") > 0))
    k = F.least("threads", "__n")
    n = n.withColumn("__per", idiv(F.col("__n") + k - 1, k))
    last = idiv(F.col("__n") - 1, F.col("__per"))
    s = n.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(last, k - 1))))
    s = s.withColumns(
        {
            "frame_start": F.col("segment") * F.col("__per"),
            "frame_end": F.least((F.col("segment") + 1) * F.col("__per"), F.col("__n")),
        }
    )

    def at(frame: str) -> Column:
        return F.col("pts_in") + tbx.frame_start(F.col(frame), F.col("fps_num"), F.col("fps_den"))

    end = F.when(F.col("frame_end") < F.col("__n"), at("frame_end")).otherwise(F.col("pts_out"))
    return s.withColumns({"pts_start": at("frame_start"), "pts_end": end}).drop("__n", "__per")


def quantise_pts(df: DataFrame) -> DataFrame:
    """Source ticks snapped to the start of the source frame they fall in.

    Row columns: source_pts, is_still, is_vfr, fps_num, fps_den, tb_num, tb_den.
    Stills and unknown rates give 0; variable rates are snapped in the stream's own
    timebase and come back truncated.
    """
    pts, num, den = F.col("source_pts"), F.col("fps_num"), F.col("fps_den")
    tb_num, tb_den, ticks = F.col("tb_num"), F.col("tb_den"), F.lit(tbx.TICKS_PER_SECOND)
    step = idiv((wide(ticks) * wide(den)).cast(WIDE), wide(num))
    cfr = idiv(pts, step) * step
    stream = tbx.rescale_ticks(pts, F.lit(1), ticks, tb_num, tb_den)
    stream_step = idiv((wide(tb_den) * wide(den)).cast(WIDE), (wide(tb_num) * wide(num)).cast(WIDE))
    snapped = F.when(stream_step > 0, idiv(stream, stream_step) * stream_step).otherwise(stream)
    vfr = tbx.rescale_ticks(snapped, tb_num, tb_den, F.lit(1), ticks)
    out = F.when(F.col("is_still") | (num == 0), F.lit(0)).when(F.col("is_vfr"), vfr).otherwise(cfr)
    return df.withColumn("quantised_pts", out.cast("bigint"))


def clock_pts(callbacks: DataFrame) -> DataFrame:
    """Clock ticks after each callback, divided once from the cumulative sample count.

    ``callbacks(session_id, seq, samples, sample_rate, start_pts)``, unique by seq.
    """
    out = chunked_scan(callbacks, ["session_id"], "seq", [Scan("total", "sum", F.col("samples"))])
    ticks = idiv((wide("total") * wide(tbx.TICKS_PER_SECOND)).cast(WIDE), wide("sample_rate"))
    return out.withColumn("clock_pts", F.col("start_pts") + ticks).withColumnRenamed("total", "total_samples")


def classify_presentation(frames: DataFrame, vsync_ns: int) -> DataFrame:
    """Present, Hold or Drop by how far each frame is from the clock.

    ``frames(frame_pts, clock_pts, fps_num, fps_den)``.
    """
    length = idiv(F.col("fps_den") * tbx.NS_PER_SECOND, F.col("fps_num"))
    drift = tbx.ticks_to_ns(F.col("frame_pts") - F.col("clock_pts"))
    action = (
        F.when(drift < -length, "Drop").when(drift > F.lit(vsync_ns // 2), "Hold").otherwise("Present")
    )
    return frames.withColumns({"drift_ns": drift, "action": action})


def progress_eta(updates: DataFrame) -> DataFrame:
    """Rate and remaining seconds; no estimate in the first five frames or at the end."""
    done, total, secs = F.col("frames_done"), F.col("total_frames"), F.col("elapsed_s")
    fps = F.coalesce(F.when(secs > 0, ratio(done, secs)), F.lit(0.0))
    stalled = (secs > 0) & (fps < 0.001)
    known = (done >= 5) & (done < total) & ~stalled
    left = F.when(secs > 0, (total - done) / F.nullif(fps, F.lit(0.0))).otherwise(F.lit(0.0))
    eta = F.when(known, left)
    return updates.withColumns({"fps": fps, "eta_s": eta})


def number_frames(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Adds ``frame_index``, the rank by (order, tie) within keys."""
    return ranked(df, keys, order, tie, "frame_index")
