"""Batch edits of clip tables over many projects at once.

Every edit takes the clip table and an edit table and returns an ``Edited`` triple:
the new clips, the new keyframes (if keyframes were given) and the rejected edits
with a reason. A clip takes part in at most one edit per call; duplicates are
rejected. Clips that are merely shifted keep their id and their keyframes; pieces
that an edit creates get ids past the project's largest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.arith import WIDE, idiv_half_away, wide
from cutlake.functions.timebase import source_offset, speed_units
from cutlake.operators.rangejoin import WIDTH, overlapping_intervals
from cutlake.operators.scan import Scan, chunked_scan, new_ids, ranked
from cutlake.operators.sets import remainders
from cutlake.operators.windows import overlapped_clips
from cutlake.session import cut

CLIP = ["project_id", "clip_id"]
TRACK = ["project_id", "track_id"]


class Edited(NamedTuple):
    clips: DataFrame
    keyframes: DataFrame | None
    rejects: DataFrame


def _judge(
    clips: DataFrame, edits: DataFrame, fields: Sequence[str], rules: Sequence[tuple[Column, str]]
) -> tuple[DataFrame, DataFrame]:
    """Edits joined to their clip (columns ``c_*``), split into good and rejected ones."""
    copies = edits.groupBy(*CLIP).agg(F.count(F.lit(1)).alias("__copies"))
    mine = clips.select(*CLIP, *[F.col(f).alias(f"c_{f}") for f in fields], F.lit(True).alias("__found"))
    reason = F.when(F.col("__copies") > 1, "DuplicateEdit").when(F.col("__found").isNull(), "ClipNotFound")
    for broken, code in rules:
        reason = reason.when(broken, code)
    judged = edits.join(copies, CLIP).join(mine, CLIP, "left").withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).drop("__copies", "__found", "reason")
    bad = judged.where(F.col("reason").isNotNull()).select(*edits.columns, "reason")
    return good, bad


def _apply(clips: DataFrame, good: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Clips with the changed columns replaced on edited rows."""
    new = good.select(*CLIP, *[c.alias(f"__{n}") for n, c in changes.items()])
    out = clips.join(new, CLIP, "left")
    return out.select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in changes else F.col(c) for c in clips.columns]
    )


def _renumber(good: DataFrame, clips: DataFrame) -> DataFrame:
    """Adds ``new_id`` to the good edits, in clip id order."""
    top = clips.groupBy("project_id").agg(F.max("clip_id").alias("__top"))
    out = ranked(good, ["project_id"], "clip_id", "clip_id", "__rank").join(top, "project_id")
    return out.withColumn("new_id", F.col("__top") + F.col("__rank")).drop("__top", "__rank")


def insert_clips(clips: DataFrame, new: DataFrame) -> Edited:
    """Add clips; ``new`` has the clip columns but ``clip_id``, plus a unique ``insert_id``."""
    ok = F.coalesce(F.col("pts_in") < F.col("pts_out"), F.lit(False))
    added = new_ids(new.where(ok), clips, ["project_id"], "clip_id", "insert_id", "insert_id")
    rejects = new.where(~ok).withColumn("reason", F.lit("InvalidDuration"))
    return Edited(clips.unionByName(added.select(*clips.columns)), None, rejects)


def insert_overwrite(
    clips: DataFrame,
    new: DataFrame,
    keyframes: DataFrame | None = None,
    scale_source: bool = False,
    width: int = WIDTH,
) -> Edited:
    """Add clips and cut away whatever they cover on their track.

    Inserts count in ``insert_id`` order, later ones on top. What remains of a cut
    clip keeps its outer fades; its source start moves by the uncovered timeline
    distance, scaled by speed only on request. The first remainder keeps the id,
    the others are new. Cut clips lose their keyframes.
    """
    ok = F.coalesce(F.col("pts_in") < F.col("pts_out"), F.lit(False))
    good, rejects = new.where(ok), new.where(~ok).withColumn("reason", F.lit("InvalidDuration"))
    # Existing clips lie under every insert; an insert lies under the later ones.
    under = clips.select(*clips.columns, F.lit(-1).cast("bigint").alias("insert_id")).unionByName(
        good.withColumn("clip_id", -1 - F.col("insert_id")).select(*clips.columns, "insert_id")
    )
    knives = good.select(
        *TRACK, F.col("pts_in").alias("cut_lo"), F.col("pts_out").alias("cut_hi"), F.col("insert_id").alias("k_id")
    )
    spans = under.select(*TRACK, "clip_id", "insert_id", "pts_in", "pts_out")
    hits = overlapping_intervals(
        spans, knives, TRACK, ("pts_in", "pts_out"), ("cut_lo", "cut_hi"), width=width
    ).where("k_id > insert_id")
    # Only keys and times are written out; the attributes join back below.
    left = remainders(spans.select(*CLIP, "pts_in", "pts_out"), hits.select(*CLIP, "cut_lo", "cut_hi"), CLIP)
    left = cut(left.select(*CLIP, "piece_in", "piece_out"))
    pieces = under.join(left, CLIP)

    moved = F.col("piece_in") - F.col("pts_in")
    skipped = source_offset(moved, F.col("speed")) if scale_source else moved
    is_head, is_tail = F.col("piece_in") == F.col("pts_in"), F.col("piece_out") == F.col("pts_out")
    pieces = pieces.withColumns(
        {
            "source_in": F.col("source_in") + skipped,
            "fade_in_pts": F.when(is_head, F.col("fade_in_pts")).otherwise(0),
            "fade_out_pts": F.when(is_tail, F.col("fade_out_pts")).otherwise(0),
            "__cut": ~(is_head & is_tail),
        }
    )
    first = left.groupBy(*CLIP).agg(F.min("piece_in").alias("__first"))
    pieces = pieces.join(first, CLIP).withColumns({"pts_in": F.col("piece_in"), "pts_out": F.col("piece_out")})
    keeps = (F.col("insert_id") < 0) & (F.col("pts_in") == F.col("__first"))
    # Pieces of one parent never share a start, so (start, parent) orders them fully.
    fresh = new_ids(
        pieces.where(~keeps).withColumn("__parent", F.col("clip_id")), clips, ["project_id"], "clip_id", "pts_in", "__parent"
    )
    out = pieces.where(keeps).select(*clips.columns).unionByName(fresh.select(*clips.columns))
    kept = None
    if keyframes is not None:
        whole = pieces.where(keeps & ~F.col("__cut")).select(*CLIP)
        kept = keyframes.join(whole, CLIP, "left_semi")
    return Edited(out, kept, rejects)


def remove_clips(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Drop clips and their keyframes."""
    good, bad = _judge(clips, edits, [], [])
    gone = good.select(*CLIP)
    left = keyframes.join(gone, CLIP, "left_anti") if keyframes is not None else None
    return Edited(clips.join(gone, CLIP, "left_anti"), left, bad)


def _move_keyframes(keyframes: DataFrame | None, good: DataFrame, delta: Column, new_id: Column):
    if keyframes is None:
        return None
    by = good.select(*CLIP, delta.alias("__delta"), new_id.alias("__new"))
    out = keyframes.join(by, CLIP, "left").withColumns(
        {"pts": F.col("pts") + F.coalesce("__delta", F.lit(0)), "clip_id": F.coalesce("__new", "clip_id")}
    )
    return out.select(*keyframes.columns)


def move_clips(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Move to ``new_pts_in``, keeping the length; keyframes travel along. New ids."""
    good, bad = _judge(clips, edits, ["pts_in", "pts_out"], [])
    good = _renumber(good, clips)
    delta = F.col("new_pts_in") - F.col("c_pts_in")
    out = _apply(
        clips,
        good,
        {"pts_in": F.col("new_pts_in"), "pts_out": F.col("c_pts_out") + delta, "clip_id": F.col("new_id")},
    )
    return Edited(out, _move_keyframes(keyframes, good, delta, F.col("new_id")), bad)


def _trim_keyframes(keyframes, good, lo: Column, hi: Column, new_id: Column):
    """Keys of edited clips kept inside [lo, hi], both ends included."""
    if keyframes is None:
        return None
    by = good.select(*CLIP, lo.alias("__lo"), hi.alias("__hi"), new_id.alias("__new"))
    out = keyframes.join(by, CLIP, "left")
    out = out.where(F.col("__lo").isNull() | F.col("pts").between(F.col("__lo"), F.col("__hi")))
    return out.withColumn("clip_id", F.coalesce("__new", "clip_id")).select(*keyframes.columns)


def trim_in(
    clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None, scale_source: bool = False
) -> Edited:
    """Move the start to ``new_pts_in``; the source start follows. New ids."""
    delta = F.col("new_pts_in") - F.col("c_pts_in")
    source = F.col("c_source_in") + (source_offset(delta, F.col("c_speed")) if scale_source else delta)
    rules = [
        (F.col("new_pts_in") >= F.col("c_pts_out"), "TrimPastOppositeEnd"),
        (source < 0, "SourceInBeforeStart"),
    ]
    good, bad = _judge(clips, edits, ["pts_in", "pts_out", "source_in", "speed"], rules)
    good = _renumber(good, clips)
    out = _apply(clips, good, {"pts_in": F.col("new_pts_in"), "source_in": source, "clip_id": F.col("new_id")})
    kept = _trim_keyframes(keyframes, good, F.col("new_pts_in"), F.col("c_pts_out"), F.col("new_id"))
    return Edited(out, kept, bad)


def trim_out(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Move the end to ``new_pts_out``."""
    rules = [(F.col("new_pts_out") <= F.col("c_pts_in"), "TrimPastOppositeEnd")]
    good, bad = _judge(clips, edits, ["pts_in"], rules)
    out = _apply(clips, good, {"pts_out": F.col("new_pts_out")})
    kept = _trim_keyframes(keyframes, good, F.col("c_pts_in"), F.col("new_pts_out"), F.col("clip_id"))
    return Edited(out, kept, bad)


def split_clips(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Cut at ``split_pts``, strictly inside. The tail is new and starts at the
    speed-scaled source position; a key exactly at the cut goes to both parts."""
    t = F.col("split_pts")
    rules = [((t <= F.col("c_pts_in")) | (t >= F.col("c_pts_out")), "TrimPastOppositeEnd")]
    good, bad = _judge(clips, edits, ["pts_in", "pts_out"], rules)
    good = _renumber(good, clips).select(*CLIP, "split_pts", "new_id")

    part = F.explode(F.when(t.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2))))
    parts = clips.join(good, CLIP, "left").withColumn("__part", part)
    head, tail = F.col("__part") == 1, F.col("__part") == 2
    played = source_offset(t - F.col("pts_in"), F.col("speed"))
    changed = {
        "clip_id": F.when(tail, F.col("new_id")).otherwise(F.col("clip_id")),
        "pts_in": F.when(tail, t).otherwise(F.col("pts_in")),
        "pts_out": F.when(head, t).otherwise(F.col("pts_out")),
        "source_in": F.when(tail, F.col("source_in") + played).otherwise(F.col("source_in")),
        "fade_in_pts": F.when(tail, F.lit(0)).otherwise(F.col("fade_in_pts")),
        "fade_out_pts": F.when(head, F.lit(0)).otherwise(F.col("fade_out_pts")),
    }
    out = parts.select(*[changed[c].alias(c) if c in changed else c for c in clips.columns])

    kept = None
    if keyframes is not None:
        spans = clips.select(*CLIP, F.col("pts_in").alias("__in"), F.col("pts_out").alias("__out")).join(good, CLIP)
        k = keyframes.join(spans, CLIP, "left").withColumn("__part", part)
        inside = (
            (F.col("__part") == 0)
            | (head & F.col("pts").between(F.col("__in"), t))
            | (tail & F.col("pts").between(t, F.col("__out")))
        )
        k = k.where(inside).withColumn("clip_id", F.when(tail, F.col("new_id")).otherwise(F.col("clip_id")))
        kept = k.select(*keyframes.columns)
    return Edited(out, kept, bad)


def _shift_by_time(clips: DataFrame, steps: DataFrame, keyframes: DataFrame | None):
    """Clips moved left by the summed ``dur`` of the steps at or before their start.

    ``steps(project_id, track_id, at, dur)``.
    """
    axis = (
        steps.select(*TRACK, F.col("at").alias("t"), "dur")
        .unionByName(clips.select(*TRACK, F.col("pts_in").alias("t"), F.lit(0).cast("bigint").alias("dur")))
        .groupBy(*TRACK, "t")
        .agg(F.sum("dur").alias("dur"))
    )
    shift = chunked_scan(axis, TRACK, "t", [Scan("shift", "sum", F.col("dur"))])
    shift = shift.select(*TRACK, F.col("t").alias("pts_in"), "shift")
    moved = clips.join(shift, [*TRACK, "pts_in"])
    kept = None
    if keyframes is not None:
        by = moved.select(*CLIP, "shift")
        k = keyframes.join(by, CLIP).withColumn("pts", F.col("pts") - F.col("shift"))
        kept = k.select(*keyframes.columns)
    moved = moved.withColumns(
        {"pts_out": F.col("pts_out") - F.col("shift"), "pts_in": F.col("pts_in") - F.col("shift")}
    )
    return moved.select(*clips.columns), kept


def ripple_remove(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Remove clips and close their gaps: later clips of the track shift left."""
    good, bad = _judge(clips, edits, ["track_id", "pts_in", "pts_out"], [])
    steps = good.select(
        "project_id", F.col("c_track_id").alias("track_id"), F.col("c_pts_out").alias("at"),
        (F.col("c_pts_out") - F.col("c_pts_in")).alias("dur"),
    )
    rest = clips.join(good.select(*CLIP), CLIP, "left_anti")
    moved, kept = _shift_by_time(rest, steps, keyframes)
    return Edited(moved, kept, bad)


def push_boundary(clips: DataFrame, inserts: DataFrame) -> DataFrame:
    """New start of every clip that ends after its track's insert point.

    ``inserts(project_id, track_id, p, d)``: point and length. Clips are pushed only
    as far as needed, in order of (start, id): with length L_i past the point and
    D_i the lengths before it, start_i = D_i + max(p + d, max_{j<=i}(in_j - D_j)),
    clips straddling the point being left out of the inner maximum.
    """
    after = clips.join(inserts, TRACK).where(F.col("pts_out") > F.col("p"))
    after = after.withColumn("len", F.col("pts_out") - F.greatest("pts_in", "p"))
    # Clips with one start act as a block: the first of them sets the maximum.
    block = after.groupBy(*TRACK, "pts_in").agg(F.sum("len").alias("len"), F.max("p").alias("p"))
    d = chunked_scan(block, TRACK, "pts_in", [Scan("ahead", "sum", F.col("len"), inclusive=False)])
    d = d.withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    lead = F.when(F.col("pts_in") >= F.col("p"), F.col("pts_in") - F.col("ahead"))
    m = chunked_scan(d.withColumn("lead", lead), TRACK, "pts_in", [Scan("floor", "max", F.col("lead"))])
    m = m.select(*TRACK, "pts_in", "ahead", "floor")
    within = chunked_scan(
        after.select(*TRACK, "pts_in", "clip_id", "len"), [*TRACK, "pts_in"], "clip_id",
        [Scan("w", "sum", F.col("len"), inclusive=False)],
    ).select(*TRACK, "pts_in", "clip_id", "w")
    out = after.join(m, [*TRACK, "pts_in"]).join(within, [*TRACK, "pts_in", "clip_id"])
    start = F.col("ahead") + F.coalesce("w", F.lit(0)) + F.greatest(F.col("p") + F.col("d"), F.col("floor"))
    return out.withColumn("new_in", start).drop("len", "ahead", "floor", "w")


# What ripple edits move. All else of a clip is joined back once, by the clip or the edit it comes from.
_MOVED = ["track_id", "source_id", "pts_in", "pts_out", "source_in", "fade_in_pts", "fade_out_pts"]


def _numbered(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits with ``__round``, their place among those of their project, and ``__rounds``, how many those are; rejects.

    The order is that of ``seq``. Without such a column a project may have one edit only.
    """
    key = ["project_id", "seq"] if "seq" in edits.columns else ["project_id"]
    copies = edits.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    known = edits.join(copies, key, "left")
    known = known.withColumn("reason", F.when(F.col("__n") > 1, "DuplicateEdit"))
    if "seq" in edits.columns:
        known = known.withColumn("reason", F.when(F.col("seq").isNull(), "MissingOrder").otherwise(F.col("reason")))
    known = known.drop("__n")
    bad = known.where(F.col("reason").isNotNull())
    good = known.where(F.col("reason").isNull()).drop("reason")
    if "seq" not in edits.columns:
        return good.withColumns({"__round": F.lit(1), "__rounds": F.lit(1)}), bad
    good = ranked(good.withColumn("__at", F.col("seq").cast("bigint")), ["project_id"], "__at", "__at", "__round").drop("__at")
    last = good.groupBy("project_id").agg(F.max("__round").alias("__rounds"))
    return good.join(last, "project_id"), bad


def _begun(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """The narrow state of ripple edits.

    ``__of`` or ``__born`` name the clip or edit that the other columns come from, ``__keys``
    the clip whose keyframes this one has, ``__by`` how far these have moved and ``__until``
    the last of them it keeps, on the clip's first time axis.
    """
    rounds = edits.select("project_id", "__rounds").distinct()
    state = clips.join(rounds, "project_id", "left").select(
        *CLIP, *_MOVED, F.coalesce("__rounds", F.lit(0)).alias("__rounds"), F.col("clip_id").alias("__of"), F.lit(None).cast("bigint").alias("__born"),
        F.col("clip_id").alias("__keys"), F.lit(0).cast("bigint").alias("__by"), F.lit(None).cast("bigint").alias("__until"),
    )
    return cut(state)


def _inserted(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state after one ripple insert per project. ``fresh`` has the columns of the state but clip_id."""
    at = fresh.select(*TRACK, F.col("pts_in").alias("p"), (F.col("pts_out") - F.col("pts_in")).alias("d"))
    pushed = push_boundary(state, at).select(
        *CLIP, "track_id", "source_id", "pts_in", "p", "new_in", (F.col("pts_in") < F.col("p")).alias("split")
    )
    pushed = cut(pushed.where(F.col("split") | (F.col("new_in") > F.col("pts_in"))))
    # What a linked clip copies from its primary; the lowest id decides among several.
    leader = pushed.groupBy("project_id", "source_id", "pts_in").agg(
        F.min_by(F.struct("p", "new_in", "split", F.col("track_id").alias("lead_track")), "clip_id").alias("lead")
    )
    own = pushed.select(*CLIP, F.struct("p", "new_in", "split").alias("own"))
    plan = state.join(own, CLIP, "left").join(leader, ["project_id", "source_id", "pts_in"], "left")
    follows = F.col("lead.lead_track") != F.col("track_id")
    plan = plan.withColumn("e", F.coalesce("own", F.when(follows, F.struct("lead.p", "lead.new_in", "lead.split"))))
    splits = F.coalesce(F.col("e.split") & (F.col("pts_out") > F.col("e.p")), F.lit(False))
    shifts = F.coalesce(~F.col("e.split"), F.lit(False))

    plan = plan.withColumns({"__shift": shifts, "__head": splits})
    p, to, head = F.col("e.p"), F.col("e.new_in"), F.col("__head")
    move = F.when(F.col("__shift"), to - F.col("pts_in")).otherwise(0)
    changed = {
        "pts_in": F.col("pts_in") + move,
        "pts_out": F.when(head, p).otherwise(F.col("pts_out") + move),
        "fade_out_pts": F.when(head, F.lit(0)).otherwise(F.col("fade_out_pts")),
        "__by": F.col("__by") + move,
        "__until": F.when(head, F.least("__until", p - F.col("__by"))).otherwise(F.col("__until")),
    }
    stay = plan.select(*[changed[c].alias(c) if c in changed else c for c in state.columns])
    # Few clips are split. Their tails are numbered from a table of their own, as the numbering reads them several times.
    rest = {
        "pts_in": to,
        "pts_out": to + F.col("pts_out") - p,
        "source_in": F.col("source_in") + p - F.col("pts_in"),
        "fade_in_pts": F.lit(0),
        "__keys": F.lit(None),
    }
    kind = {field.name: field.dataType for field in state.schema}
    tails = plan.where(head).select(*[rest[c].cast(kind[c]).alias(c) if c in rest else c for c in state.columns], F.col("clip_id").alias("__parent"))
    first = F.lit(-1).cast("bigint")
    fresh = cut(tails).unionByName(
        fresh.withColumns({"clip_id": first, "__parent": first}).select(*state.columns, "__parent")
    )
    fresh = new_ids(fresh, state, ["project_id"], "clip_id", "pts_in", "__parent")
    return stay.unionByName(fresh.select(*state.columns))


def _finished(state: DataFrame, clips: DataFrame, new: DataFrame | None, keyframes: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Whole clips and their keyframes from the narrow state."""
    wide = [c for c in clips.columns if c not in (*CLIP, *_MOVED)]
    held = F.struct(*wide) if wide else F.lit(None)
    out = state.join(clips.select("project_id", F.col("clip_id").alias("__of"), held.alias("__old")), ["project_id", "__of"], "left")
    if new is not None:
        out = out.join(new.select("project_id", F.col("__round").alias("__born"), held.alias("__new")), ["project_id", "__born"], "left")
    source = F.col("__old") if new is None else F.coalesce("__old", "__new")
    whole = out.withColumn("__row", source) if wide else out
    done = whole.select(*[F.col(f"__row.{c}").alias(c) if c in wide else F.col(c) for c in clips.columns])
    if keyframes is None:
        return done, None
    by = state.where(F.col("__keys").isNotNull()).select("project_id", F.col("__keys").alias("clip_id"), F.col("clip_id").alias("__id"), "__by", "__until")
    k = keyframes.join(by, CLIP).where(F.col("__until").isNull() | (F.col("pts") <= F.col("__until")))
    k = k.withColumns({"pts": F.col("pts") + F.col("__by"), "clip_id": F.col("__id")})
    return done, k.select(*keyframes.columns)


def _rounds(state: DataFrame, edits: DataFrame, apply) -> tuple[DataFrame, list[DataFrame]]:
    """The state after all edits, one of each project a round, and what ``apply`` rejects.

    An edit sees what those before it made, links across tracks included, so the edits of one
    project can't run side by side; those of all projects do. Each round ends in a
    written table, and a project takes part only as long as it has edits left.
    """
    last = edits.agg(F.max("__rounds")).first()[0] or 0
    done, rejects = [state.where("__rounds = 0")], []
    state = state.where("__rounds > 0")
    for n in range(1, last + 1):
        state, bad = apply(state, edits.where(F.col("__round") == n))
        if bad is not None:
            rejects.append(bad)
        state = cut(state)
        done.append(state.where(F.col("__rounds") == n))
        state = state.where(F.col("__rounds") > n)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, rejects


def ripple_insert(clips: DataFrame, new: DataFrame, keyframes: DataFrame | None = None) -> Edited:
    """Insert clips, each pushing its track's later clips only as far as needed.

    A clip across the insert point is split, its tail following the insert. Clips linked to a
    pushed or split one (same source and start, other track) do the same. With a column
    ``seq`` any number of inserts per project are applied in that order (one that is taken
    twice, or null, rejects its inserts); without it a project may have one.
    """
    order = [c for c in ("seq",) if c in new.columns]
    valid = F.col("pts_in") < F.col("pts_out")
    short = new.where(~F.coalesce(valid, F.lit(False))).withColumn("reason", F.lit("InvalidDuration"))
    good, bad = _numbered(new.where(valid))
    if not order:
        # One that is void still takes the project's only place.
        several = new.groupBy("project_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("project_id")
        crowded = new.join(several, "project_id", "left_semi").withColumn("reason", F.lit("DuplicateEdit"))
        short = short.join(several, "project_id", "left_anti").unionByName(crowded.select(*short.columns))
        bad = bad.limit(0)
        good = good.join(several, "project_id", "left_anti")
    good = cut(good)

    def apply(state: DataFrame, now: DataFrame):
        nothing = F.lit(None).cast("bigint")
        fresh = now.withColumns({"__of": nothing, "__born": F.col("__round").cast("bigint"), "__keys": nothing, "__by": F.lit(0).cast("bigint"), "__until": nothing})
        return _inserted(state, fresh), None

    # A project without clips takes inserts too.
    state, _ = _rounds(_begun(clips, good), good, apply)
    out, kept = _finished(state, clips, good.withColumn("__round", F.col("__round").cast("bigint")), keyframes)
    return Edited(out, kept, bad.select(*new.columns, "reason").unionByName(short.select(*new.columns, "reason")))


def ripple_move(clips: DataFrame, edits: DataFrame, keyframes: DataFrame | None = None, tracks: DataFrame | None = None) -> Edited:
    """Take clips out, closing their gaps, and ripple-insert them at (new_track, new_pts_in).

    With a column ``seq`` any number of moves per project are applied in that order, each to
    the clips as the one before left them; without it a project may have one, and of several
    all are rejected. The moved clip gets a new id and takes its keyframes along. With
    ``tracks`` the layers of both tracks of a move between tracks are numbered anew.
    """
    static = F.col("new_track").isNull() | F.col("new_pts_in").isNull()
    if "seq" in edits.columns:
        void = edits.where(static).withColumn("reason", F.lit("MissingTarget"))
        good, bad = _numbered(edits.where(~static))
        bad = bad.select(*edits.columns, "reason").unionByName(void.select(*edits.columns, "reason"))
    else:
        rules = [(static, "MissingTarget"), (F.coalesce(F.col("c_pts_in") >= F.col("c_pts_out"), F.lit(True)), "InvalidDuration")]
        single, bad = _judge(clips, edits, ["pts_in", "pts_out"], rules)
        good, several = _numbered(single.select(*edits.columns))
        bad = bad.unionByName(several.select(*bad.columns))
    good = cut(good)
    crossed = []

    def apply(state: DataFrame, now: DataFrame):
        # The few clips that move are picked first, so that the join to the edits doesn't deal out all others.
        named = state.drop("__rounds").join(now.select(*CLIP), CLIP, "left_semi")
        found = now.join(named, CLIP, "left")
        reason = F.when(F.col("pts_in").isNull(), "ClipNotFound").when(F.col("pts_in") >= F.col("pts_out"), "InvalidDuration")
        found = cut(found.withColumn("reason", reason))
        going = found.where(F.col("reason").isNull())
        crossed.append(going.where(F.col("new_track") != F.col("track_id")).select("project_id", F.explode(F.array("track_id", F.col("new_track").cast(state.schema["track_id"].dataType))).alias("track_id")))
        gap = going.select(*TRACK, F.col("clip_id").alias("__gone"), F.col("pts_out").alias("__from"), (F.col("pts_out") - F.col("pts_in")).alias("__gap"))
        rest = state.join(gap, TRACK, "left").where(~F.col("clip_id").eqNullSafe(F.col("__gone")))
        back = F.when(F.col("pts_in") >= F.col("__from"), F.col("__gap")).otherwise(0)
        rest = rest.withColumns({c: F.col(c) - back for c in ("pts_out", "__by", "pts_in")}).select(*state.columns)
        step = F.col("new_pts_in") - F.col("pts_in")
        fresh = going.withColumns({
            "track_id": F.col("new_track").cast(state.schema["track_id"].dataType), "pts_out": F.col("pts_out") + step, "__by": F.col("__by") + step, "pts_in": F.col("new_pts_in"),
        })
        return _inserted(cut(rest), fresh.select(*[c for c in state.columns if c != "clip_id"])), found.where(F.col("reason").isNotNull()).select(*edits.columns, "reason")

    state, rejects = _rounds(_begun(clips, good), good, apply)
    for more in rejects:
        bad = bad.unionByName(more)
    out, kept = _finished(state, clips, None, keyframes)
    if tracks is not None and crossed:
        touched = crossed[0]
        for more in crossed[1:]:
            touched = touched.unionByName(more)
        touched = cut(touched.distinct())
        layered = reindex_layers(out.join(touched, TRACK, "left_semi"), tracks)
        out = out.join(touched, TRACK, "left_anti").unionByName(layered)
    return Edited(out, kept, bad)


def slip(clips: DataFrame, edits: DataFrame) -> Edited:
    """Move the source start by ``delta``; the timeline stays."""
    source = F.col("c_source_in") + F.col("delta")
    good, bad = _judge(clips, edits, ["source_in"], [(source < 0, "SourceInBeforeStart")])
    return Edited(_apply(clips, good, {"source_in": source}), None, bad)


def slide(clips: DataFrame, edits: DataFrame) -> Edited:
    """Move clips by ``delta``; clips touching either end absorb it.

    A following neighbour's source start moves too. A slide whose neighbour slides
    in the same call is rejected as ConflictingEdit.
    """
    starts_below = F.col("c_pts_in") + F.col("delta") < 0
    good, bad = _judge(clips, edits, ["track_id", "pts_in", "pts_out"], [(starts_below, "InvalidDuration")])
    good = good.where("delta <> 0").withColumnRenamed("c_track_id", "track_id")
    ends = good.select(*TRACK, F.col("c_pts_out").alias("c_pts_in")).distinct().withColumn("__l", F.lit(True))
    begins = good.select(*TRACK, F.col("c_pts_in").alias("c_pts_out")).distinct().withColumn("__r", F.lit(True))
    touched = good.join(ends, [*TRACK, "c_pts_in"], "left").join(begins, [*TRACK, "c_pts_out"], "left")
    clash = F.coalesce("__l", "__r").isNotNull()
    bad = bad.unionByName(
        touched.where(clash).select(*edits.columns).withColumn("reason", F.lit("ConflictingEdit"))
    )
    good = touched.where(~clash).drop("__l", "__r")

    left = good.groupBy(*TRACK, F.col("c_pts_in").alias("pts_out")).agg(F.min_by("delta", "clip_id").alias("__dl"))
    right = good.groupBy(*TRACK, F.col("c_pts_out").alias("pts_in")).agg(F.min_by("delta", "clip_id").alias("__dr"))
    own = good.select(*CLIP, F.col("delta").alias("__d"))
    out = clips.join(own, CLIP, "left").join(left, [*TRACK, "pts_out"], "left").join(right, [*TRACK, "pts_in"], "left")
    zero = F.lit(0)
    changed = {
        "pts_in": F.col("pts_in") + F.coalesce("__d", "__dr", zero),
        "pts_out": F.col("pts_out") + F.coalesce("__d", "__dl", zero),
        "source_in": F.col("source_in") + F.when(F.col("__d").isNull(), F.coalesce("__dr", zero)).otherwise(zero),
    }
    return Edited(out.select(*[changed[c].alias(c) if c in changed else c for c in clips.columns]), None, bad)


def roll(clips: DataFrame, edits: DataFrame) -> Edited:
    """Move the cut between ``left_id`` and ``right_id`` by ``delta``.

    A clip may take part in one roll per call.
    """
    roles = edits.select(
        "project_id", F.explode(F.array("left_id", "right_id")).alias("clip_id")
    ).groupBy(*CLIP).agg(F.count(F.lit(1)).alias("uses"))
    out = edits
    for side, fields in (("left", ["pts_in", "pts_out"]), ("right", ["pts_out", "source_in"])):
        c = clips.select(
            "project_id", F.col("clip_id").alias(f"{side}_id"), *[F.col(f).alias(f"{side}_{f}") for f in fields]
        )
        u = roles.select("project_id", F.col("clip_id").alias(f"{side}_id"), F.col("uses").alias(f"{side}_uses"))
        out = out.join(u, ["project_id", f"{side}_id"]).join(c, ["project_id", f"{side}_id"], "left")
    cut = F.col("left_pts_out") + F.col("delta")
    reason = (
        F.when((F.col("left_uses") > 1) | (F.col("right_uses") > 1), "DuplicateEdit")
        .when(F.col("left_pts_in").isNull() | F.col("right_pts_out").isNull(), "ClipNotFound")
        .when((cut <= F.col("left_pts_in")) | (cut >= F.col("right_pts_out")), "TrimPastOppositeEnd")
        .when(F.col("right_source_in") + F.col("delta") < 0, "SourceInBeforeStart")
    )
    out = out.withColumns({"cut": cut, "reason": reason})
    bad = out.where(F.col("reason").isNotNull()).select(*edits.columns, "reason")
    good = out.where(F.col("reason").isNull())
    null = F.lit(None).cast("bigint")
    edges = good.select("project_id", F.col("left_id").alias("clip_id"), F.col("cut").alias("o"), null.alias("i"), null.alias("s")).unionByName(
        good.select(
            "project_id", F.col("right_id").alias("clip_id"), null.alias("o"), F.col("cut").alias("i"),
            (F.col("right_source_in") + F.col("delta")).alias("s"),
        )
    )
    return Edited(
        _apply(clips, edges, {"pts_out": F.col("o"), "pts_in": F.col("i"), "source_in": F.col("s")}), None, bad
    )


def duplicate(clips: DataFrame, edits: DataFrame) -> Edited:
    """Copy each clip right after itself, over whatever is there."""
    good, bad = _judge(clips, edits, [], [])
    copies = clips.join(good.select(*CLIP), CLIP).withColumns(
        {"pts_in": F.col("pts_out"), "pts_out": F.col("pts_out") * 2 - F.col("pts_in"), "insert_id": F.col("clip_id")}
    )
    out = insert_overwrite(clips, copies.drop("clip_id"))
    return Edited(out.clips, None, bad)


def duplicate_to(clips: DataFrame, edits: DataFrame) -> Edited:
    """Copy each clip to (``to_track``, ``to_pts_in``) without touching others."""
    good, bad = _judge(clips, edits, [], [])
    copies = clips.join(good.select(*CLIP, "to_track", "to_pts_in"), CLIP).withColumns(
        {
            "track_id": F.col("to_track"),
            "pts_out": F.col("to_pts_in") + F.col("pts_out") - F.col("pts_in"),
            "pts_in": F.col("to_pts_in"),
            "insert_id": F.col("clip_id"),
        }
    )
    out = insert_clips(clips, copies.drop("clip_id", "to_track", "to_pts_in"))
    return Edited(out.clips, None, bad)


def batch_move(clips: DataFrame, edits: DataFrame) -> Edited:
    """Shift clips by ``delta``, row by row; a start before zero is rejected."""
    start = F.col("c_pts_in") + F.col("delta")
    good, bad = _judge(clips, edits, ["pts_in", "pts_out"], [(start < 0, "InvalidDuration")])
    out = _apply(clips, good, {"pts_in": start, "pts_out": F.col("c_pts_out") + F.col("delta")})
    return Edited(out, None, bad)


def update_clips(clips: DataFrame, changes: DataFrame) -> Edited:
    """Set attributes: every non-NULL column of ``changes`` replaces the clip's.

    Opacity outside 0..1 is rejected, negative fades become 0, and a new speed
    rescales the clip's length by old/new.
    """
    fields = [c for c in changes.columns if c not in CLIP]
    rules = []
    if "opacity" in fields:
        rules.append((~F.col("opacity").between(0.0, 1.0), "InvalidOpacity"))
    good, bad = _judge(clips, changes, ["pts_in", "pts_out", "speed"], rules)
    new = {f: F.col(f) for f in fields}
    for fade in ("fade_in_pts", "fade_out_pts"):
        if fade in new:
            new[fade] = F.when(F.col(fade).isNotNull(), F.greatest(F.col(fade), F.lit(0)))
    if "speed" in fields:
        changed = F.abs(F.col("speed") - F.col("c_speed")) > 1e-4
        length = (wide(F.col("c_pts_out") - F.col("c_pts_in")) * wide(speed_units(F.col("c_speed")))).cast(WIDE)
        rescaled = idiv_half_away(length, wide(speed_units(F.col("speed"))))
        new["pts_out"] = F.when(changed, F.col("c_pts_in") + rescaled)
        new["speed"] = F.when(changed, F.col("speed"))
    return Edited(_apply(clips, good, new), None, bad)


def check_integrity(
    clips: DataFrame, tracks: DataFrame, sources: DataFrame, keyframes: DataFrame
) -> DataFrame:
    """Everything wrong with the tables: (project_id, clip_id, problem)."""

    def say(df: DataFrame, problem: str) -> DataFrame:
        return df.select(*CLIP, F.lit(problem).alias("problem"))

    key = [*CLIP, "param", "pts"]
    doubled = keyframes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = [
        say(clips.where("pts_in >= pts_out"), "BadDuration"),
        say(clips.where("source_in < 0"), "SourceInBeforeStart"),
        say(overlapped_clips(clips), "Overlap"),
        say(clips.join(tracks.select(*TRACK), TRACK, "left_anti"), "UnknownTrack"),
        say(clips.join(sources.select("project_id", "source_id"), ["project_id", "source_id"], "left_anti"), "UnknownSource"),
        say(keyframes.select(*CLIP).distinct().join(clips.select(*CLIP), CLIP, "left_anti"), "OrphanKeyframe"),
        say(doubled.select(*CLIP).distinct(), "DuplicateKeyframe"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


KEY = [*CLIP, "param", "pts"]


def keyframes_apply(keyframes: DataFrame, ops: DataFrame) -> DataFrame:
    """Set or remove keys; the op with the highest ``seq`` per key wins.

    ``ops(project_id, clip_id, param, pts, seq, op, value, interp)``, op 'set' or 'remove'.
    """
    last = ops.groupBy(*KEY).agg(F.max_by(F.struct("op", "value", "interp"), "seq").alias("o"))
    out = keyframes.join(last, KEY, "full").where(F.col("o").isNull() | (F.col("o.op") == "set"))
    return out.select(
        *KEY, *[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "interp")]
    )


def keyframes_move(keyframes: DataFrame, moves: DataFrame) -> DataFrame:
    """Move single keys to ``new_pts``; a key already there is replaced."""
    moving = keyframes.join(moves.select(*KEY, "new_pts"), KEY)
    ops = moving.select(*KEY, F.lit(0).alias("seq"), F.lit("remove").alias("op"), "value", "interp").unionByName(
        moving.select(
            *CLIP, "param", F.col("new_pts").alias("pts"), F.lit(1).alias("seq"), F.lit("set").alias("op"), "value", "interp"
        )
    )
    return keyframes_apply(keyframes, ops)


def keyframes_shift(keyframes: DataFrame, shifts: DataFrame) -> DataFrame:
    """Shift all keys of a clip by ``delta``."""
    return _move_keyframes(keyframes, shifts, F.col("delta"), F.col("clip_id"))


def keyframes_copy(keyframes: DataFrame, copies: DataFrame) -> DataFrame:
    """Keys of ``clip_id`` added to ``dest_id``, within [start_pts, end_pts] if given."""
    out = keyframes.join(copies.select(*CLIP, "dest_id", "start_pts", "end_pts"), CLIP)
    out = out.where(F.col("start_pts").isNull() | F.col("pts").between(F.col("start_pts"), F.col("end_pts")))
    return keyframes.unionByName(out.withColumn("clip_id", F.col("dest_id")).select(*keyframes.columns))


def reindex_layers(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Layer number from track position (high byte) and place on the track (low byte)."""
    place = ranked(clips.drop("layer_order"), TRACK, "pts_in", "clip_id", "__slot")
    out = place.join(tracks.select(*TRACK, "position"), TRACK, "left")
    high = F.shiftleft(F.coalesce("position", F.lit(0)).bitwiseAND(255), 8)
    low = (F.col("__slot") - 1).cast("int").bitwiseAND(255)
    return out.withColumn("layer_order", high.bitwiseOR(low)).select(*clips.columns)


def next_layer_slot(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """First unused layer number of each track; low byte 0 when all 256 are taken."""
    low = F.col("layer_order").bitwiseAND(255)
    used = clips.groupBy(*TRACK).agg(F.collect_set(low).alias("used"))  # at most 256 values
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(255)), F.coalesce("used", F.array().cast("array<int>"))))
    high = F.shiftleft(F.col("position").bitwiseAND(255), 8)
    return tracks.join(used, TRACK, "left").select(
        *TRACK, high.bitwiseOR(F.coalesce(free, F.lit(0))).alias("layer_order")
    )


def as_of_version(snapshots: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Each project's newest snapshot at or before ``wanted(project_id, version)``.

    Only a project's newest n snapshots exist; tasks prune to n before the shuffle.
    """
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("version")))
    live = snapshots.withColumn("__nth", newest).where(F.col("__nth") <= n).drop("__nth")
    ask = wanted.select("project_id", F.col("version").alias("as_of"))
    rest = [c for c in snapshots.columns if c != "project_id"]
    return (
        live.join(ask, "project_id")
        .where(F.col("version") <= F.col("as_of"))
        .groupBy("project_id", "as_of")
        .agg(F.max_by(F.struct(*rest), "version").alias("s"))
        .select("project_id", "as_of", "s.*")
    )
