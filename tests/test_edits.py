"""Batch edits against step-by-step models on random small timelines."""

import os
import random

import pytest

from cutlake.operators import edits

SCHEMA = (
    "project_id bigint, clip_id bigint, track_id int, source_id bigint, pts_in bigint, pts_out bigint, "
    "source_in bigint, fade_in_pts bigint, fade_out_pts bigint, speed double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def library(rng, projects=6, per=9, tracks=2):
    out = []
    for p in range(projects):
        for i in range(per):
            lo = rng.randint(0, 60)
            out.append((p, i, rng.randrange(tracks), rng.randrange(3), lo, lo + rng.randint(1, 25), rng.randint(0, 9), 2, 3, 1.0))
    return out


def shape(df):
    return sorted((r.project_id, r.track_id, r.source_id, r.pts_in, r.pts_out, r.source_in) for r in df.collect())


def model_overwrite(rows, new):
    tracks = [dict(zip(NAMES, r)) for r in rows]
    for n in new:
        kept = []
        for c in tracks:
            same = c["project_id"] == n["project_id"] and c["track_id"] == n["track_id"]
            if not same or c["pts_out"] <= n["pts_in"] or c["pts_in"] >= n["pts_out"]:
                kept.append(c)
                continue
            if c["pts_in"] < n["pts_in"]:
                kept.append({**c, "pts_out": n["pts_in"]})
            if c["pts_out"] > n["pts_out"]:
                kept.append({**c, "pts_in": n["pts_out"], "source_in": c["source_in"] + n["pts_out"] - c["pts_in"]})
        tracks = [*kept, n]
    return sorted((c["project_id"], c["track_id"], c["source_id"], c["pts_in"], c["pts_out"], c["source_in"]) for c in tracks)


@pytest.mark.parametrize("seed", range(3))
def test_overwrite_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = library(rng)
    new = []
    for i in range(14):
        lo = rng.randint(0, 70)
        new.append(dict(zip(NAMES, (rng.randrange(6), None, rng.randrange(2), 99, lo, lo + rng.randint(1, 40), 0, 0, 0, 1.0))))
    table = spark.createDataFrame(
        [tuple(n[c] for c in NAMES if c != "clip_id") + (i,) for i, n in enumerate(new)],
        SCHEMA.replace("clip_id bigint, ", "") + ", insert_id bigint",
    )
    got = edits.insert_overwrite(spark.createDataFrame(rows, SCHEMA), table, width=16).clips
    assert shape(got) == model_overwrite(rows, new)
    ids = [(r.project_id, r.clip_id) for r in got.collect()]
    assert len(ids) == len(set(ids))


def model_ripple(rows, n):
    """Push the clips of one track past an insert, then do the same to linked ones."""
    clips = [dict(zip(NAMES, r)) for r in rows if r[0] == n["project_id"]]
    rest = [dict(zip(NAMES, r)) for r in rows if r[0] != n["project_id"]]
    point, edge = n["pts_in"], n["pts_out"]
    todo = {}
    for c in sorted((c for c in clips if c["track_id"] == n["track_id"]), key=lambda c: (c["pts_in"], c["clip_id"])):
        if c["pts_out"] <= point:
            continue
        if c["pts_in"] < point:
            todo[c["clip_id"]] = ("split", edge)
            edge += c["pts_out"] - point
        elif c["pts_in"] < edge:
            todo[c["clip_id"]] = ("shift", edge)
            edge += c["pts_out"] - c["pts_in"]
        else:
            edge = c["pts_out"]
    linked = {}
    by_id = {c["clip_id"]: c for c in clips}
    for cid in sorted(todo):
        lead = by_id[cid]
        for c in clips:
            if c["track_id"] != lead["track_id"] and (c["source_id"], c["pts_in"]) == (lead["source_id"], lead["pts_in"]):
                linked.setdefault(c["clip_id"], todo[cid])
    out = [*rest, n]
    for c in clips:
        what, to = todo.get(c["clip_id"]) or linked.get(c["clip_id"]) or (None, None)
        if what == "split" and c["pts_out"] > point:
            out.append({**c, "pts_out": point})
            out.append({**c, "pts_in": to, "pts_out": to + c["pts_out"] - point, "source_in": c["source_in"] + point - c["pts_in"]})
        elif what == "shift":
            out.append({**c, "pts_in": to, "pts_out": to + c["pts_out"] - c["pts_in"]})
        else:
            out.append(c)
    return sorted((c["project_id"], c["track_id"], c["source_id"], c["pts_in"], c["pts_out"], c["source_in"]) for c in out)


@pytest.mark.parametrize("seed", range(3))
def test_ripple_insert_equals_stepwise_push(spark, seed):
    rng = random.Random(seed + 50)
    rows = library(rng, projects=5, per=10)
    # Some clips get a partner on the other track with the same source and start.
    for r in list(rows):
        if rng.random() < 0.4:
            top = max(x[1] for x in rows if x[0] == r[0])
            rows.append((r[0], top + 1, 1 - r[2], r[3], r[4], r[5] + rng.choice([0, 4, -1]) if r[5] - r[4] > 2 else r[5], r[6], 2, 3, 1.0))
    want_rows, news = rows, []
    for p in range(5):
        lo = rng.randint(0, 50)
        news.append(dict(zip(NAMES, (p, -5, rng.randrange(2), 99, lo, lo + rng.randint(1, 20), 0, 0, 0, 1.0))))
    for n in news:
        want = model_ripple(want_rows, n)
        mine = {t[0] for t in want}
        assert n["project_id"] in mine
    table = spark.createDataFrame(
        [tuple(n[c] for c in NAMES if c != "clip_id") for n in news], SCHEMA.replace("clip_id bigint, ", "")
    )
    got = shape(edits.ripple_insert(spark.createDataFrame(rows, SCHEMA), table).clips)
    for n in news:
        p = n["project_id"]
        assert [g for g in got if g[0] == p] == [w for w in model_ripple(rows, n) if w[0] == p]


def test_ripple_insert_splits_around_the_point(spark):
    rows = [(0, 0, 0, 1, 0, 10, 0, 0, 0, 1.0)]
    new = spark.createDataFrame([(0, 0, 2, 3, 8, 0, 0, 0, 1.0)], SCHEMA.replace("clip_id bigint, ", ""))
    assert shape(edits.ripple_insert(spark.createDataFrame(rows, SCHEMA), new).clips) == [
        (0, 0, 1, 0, 3, 0), (0, 0, 1, 8, 15, 3), (0, 0, 2, 3, 8, 0),
    ]


def test_roll_keeps_the_total_length(spark):
    rows = [(0, 0, 0, 1, 0, 10, 5, 0, 0, 1.0), (0, 1, 0, 1, 10, 30, 5, 0, 0, 1.0)]
    clips = spark.createDataFrame(rows, SCHEMA)
    e = spark.createDataFrame([(0, 0, 1, -4)], "project_id bigint, left_id bigint, right_id bigint, delta bigint")
    assert shape(edits.roll(clips, e).clips) == [(0, 0, 1, 0, 6, 5), (0, 0, 1, 6, 30, 1)]
    bad = spark.createDataFrame([(0, 0, 1, -6)], "project_id bigint, left_id bigint, right_id bigint, delta bigint")
    out = edits.roll(clips, bad)
    assert shape(out.clips) == shape(clips)
    assert [r.reason for r in out.rejects.collect()] == ["SourceInBeforeStart"]


def test_split_is_speed_scaled_and_key_at_the_cut_is_in_both(spark):
    clips = spark.createDataFrame([(0, 0, 0, 1, 0, 100, 7, 5, 6, 2.0)], SCHEMA)
    keys = spark.createDataFrame(
        [(0, 0, "Opacity", t, 1.0, "Linear") for t in (0, 40, 90)],
        "project_id bigint, clip_id bigint, param string, pts bigint, value double, interp string",
    )
    e = spark.createDataFrame([(0, 0, 40)], "project_id bigint, clip_id bigint, split_pts bigint")
    out = edits.split_clips(clips, e, keys)
    rows = sorted(tuple(r) for r in out.clips.collect())
    assert rows == [(0, 0, 0, 1, 0, 40, 7, 5, 0, 2.0), (0, 1, 0, 1, 40, 100, 87, 0, 6, 2.0)]
    assert sorted((r.clip_id, r.pts) for r in out.keyframes.collect()) == [(0, 0), (0, 40), (1, 40), (1, 90)]


def test_ripple_moves_lose_no_clip(spark):
    """Two moves in one project are both rejected; one takes its keyframes along."""
    rows = [(p, 10 * p + i, 0, 0, 1000 * i, 1000 * i + 900) for p in (1, 2) for i in range(4)]
    names = ["project_id", "clip_id", "track_id", "source_id", "pts_in", "pts_out"]
    clips = spark.createDataFrame(rows, names).selectExpr(
        "*", "0L AS source_in", "'Video' AS kind", "0 AS layer_order", "0L AS fade_in_pts", "0L AS fade_out_pts", "1e0 AS speed"
    )
    keys = spark.createDataFrame([(2, 20, "Opacity", 100, 0.5, "Linear"), (2, 23, "Opacity", 3100, 0.7, "Linear")], "project_id long, clip_id long, param string, pts long, value double, interp string")
    moves = spark.createDataFrame(
        [(1, 10, 1, 500), (1, 11, 1, 700), (2, 20, 1, 5000), (2, 99, 1, 0), (2, 21, None, 0)], "project_id long, clip_id long, new_track long, new_pts_in long"
    )
    done = edits.ripple_move(clips, moves, keys)
    after = {(r.project_id, r.clip_id): (r.track_id, r.pts_in, r.pts_out) for r in done.clips.collect()}
    assert {r.reason for r in done.rejects.where("project_id = 1").collect()} == {"DuplicateEdit"}
    assert sorted((r.clip_id, r.reason) for r in done.rejects.where("project_id = 2").collect()) == [(21, "MissingTarget"), (99, "ClipNotFound")]
    assert len(after) == 8 and [v for k, v in sorted(after.items()) if k[0] == 1] == [(0, 1000 * i, 1000 * i + 900) for i in range(4)]
    assert after[2, 24] == (1, 5000, 5900) and after[2, 21] == (0, 100, 1000)
    assert sorted((r.clip_id, r.pts) for r in done.keyframes.collect()) == [(23, 2200), (24, 5100)]


def insert_step(clips, keys, new):
    """One ripple insert into the clips {id: row} of a project and their keys {id: [pts]}, by the rules one after another."""
    point, edge, todo = new["pts_in"], new["pts_out"], {}
    for i in sorted((i for i, c in clips.items() if c["track_id"] == new["track_id"]), key=lambda i: (clips[i]["pts_in"], i)):
        c = clips[i]
        if c["pts_out"] <= point:
            continue
        if c["pts_in"] < point:
            todo[i] = ("split", edge)
            edge += c["pts_out"] - point
        elif c["pts_in"] < edge:
            todo[i] = ("shift", edge)
            edge += c["pts_out"] - c["pts_in"]
        else:
            edge = c["pts_out"]
    linked = {}
    for lead in sorted(todo):
        for i, c in clips.items():
            other = clips[lead]
            if c["track_id"] != other["track_id"] and (c["source_id"], c["pts_in"]) == (other["source_id"], other["pts_in"]):
                linked.setdefault(i, todo[lead])
    out, kept, fresh = {}, {}, [(new["pts_in"], -1, new, new.pop("keys", []))]
    for i, c in clips.items():
        what, to = todo.get(i) or linked.get(i) or (None, None)
        by, kept[i] = 0, keys.get(i, [])
        if what == "split" and c["pts_out"] > point:
            fresh.append((to, i, {**c, "pts_in": to, "pts_out": to + c["pts_out"] - point, "source_in": c["source_in"] + point - c["pts_in"], "fade_in_pts": 0}, []))
            c, kept[i] = {**c, "pts_out": point, "fade_out_pts": 0}, [t for t in kept[i] if t <= point]
        elif what == "shift":
            by = to - c["pts_in"]
        out[i] = {**c, "pts_in": c["pts_in"] + by, "pts_out": c["pts_out"] + by}
        kept[i] = [t + by for t in kept[i]]
    top = max(clips, default=-1)
    for n, (_, _, row, own) in enumerate(sorted(fresh, key=lambda f: f[:2]), 1):
        out[top + n], kept[top + n] = row, own
    return out, kept


def move_step(clips, keys, clip_id, track, at):
    gone = clips[clip_id]
    length, by = gone["pts_out"] - gone["pts_in"], at - gone["pts_in"]
    left, kept = {}, {}
    for i, c in clips.items():
        back = length if c["track_id"] == gone["track_id"] and c["pts_in"] >= gone["pts_out"] else 0
        if i != clip_id:
            left[i], kept[i] = {**c, "pts_in": c["pts_in"] - back, "pts_out": c["pts_out"] - back}, [t - back for t in keys.get(i, [])]
    return insert_step(left, kept, {**gone, "track_id": track, "pts_in": at, "pts_out": at + length, "keys": [t + by for t in keys.get(clip_id, [])]})


KEYS = "project_id bigint, clip_id bigint, param string, pts bigint, value double, interp string"


def linked_library(rng, projects):
    """Clips with partners on the other track, and their keys."""
    rows = library(rng, projects=projects, per=8)
    for r in list(rows):
        if rng.random() < 0.4:
            rows.append((r[0], max(x[1] for x in rows if x[0] == r[0]) + 1, 1 - r[2], *r[3:]))
    keys = [(r[0], r[1], "Opacity", rng.randint(r[4], r[5]), 0.5, "Linear") for r in rows for _ in range(2)]
    return rows, keys


def states(rows, keys):
    clips, held = {}, {}
    for r in rows:
        clips.setdefault(r[0], {})[r[1]] = {n: v for n, v in zip(NAMES, r, strict=True) if n not in ("project_id", "clip_id")}
    for k in keys:
        held.setdefault(k[0], {}).setdefault(k[1], []).append(k[3])
    return clips, held


def flat(clips, keys):
    order = [n for n in NAMES if n not in ("project_id", "clip_id")]
    rows = sorted((p, i, *(c[n] for n in order)) for p, held in clips.items() for i, c in held.items())
    return rows, sorted((p, i, t) for p, held in keys.items() for i, times in held.items() for t in times)


def test_many_inserts_in_order(spark):
    """Many inserts in one project, fewer in others, none in one, and a project without clips."""
    many = 20 if os.environ.get("CUTLAKE_ALL") else 5
    rng = random.Random(11)
    rows, keys = linked_library(rng, 4)
    clips, held = states(rows, keys)
    clips[9], held[9] = {}, {}
    asked = []
    for p, n in ((0, many), (1, 3), (2, 1), (9, 2)):
        for seq in rng.sample(range(100), n):
            lo = rng.randint(0, 70)
            asked.append((p, rng.randrange(2), 99, lo, lo + rng.randint(1, 20), 0, 2, 3, 1.0 + seq, seq))
    for a in sorted(asked, key=lambda a: (a[0], a[-1])):
        clips[a[0]], held[a[0]] = insert_step(clips[a[0]], held[a[0]], dict(zip([n for n in NAMES if n not in ("project_id", "clip_id")], a[1:-1], strict=True)))
    asked += [(3, 0, 99, 5, 9, 0, 0, 0, 1.0, 4), (3, 1, 99, 7, 9, 0, 0, 0, 1.0, 4), (3, 1, 99, 7, 7, 0, 0, 0, 1.0, 5)]
    new = spark.createDataFrame(asked, SCHEMA.replace("clip_id bigint, ", "") + ", seq bigint")
    done = edits.ripple_insert(spark.createDataFrame(rows, SCHEMA), new, spark.createDataFrame(keys, KEYS))
    got = sorted(tuple(r) for r in done.clips.select(NAMES).collect()), sorted((r.project_id, r.clip_id, r.pts) for r in done.keyframes.collect())
    assert got == flat(clips, held)
    assert sorted((r.project_id, r.seq, r.reason) for r in done.rejects.collect()) == [(3, 4, "DuplicateEdit"), (3, 4, "DuplicateEdit"), (3, 5, "InvalidDuration")]


def test_many_moves_in_order(spark):
    """Moves see what those before them made; a clip that has moved has another id."""
    rng = random.Random(12)
    rows, keys = linked_library(rng, 3)
    clips, held = states(rows, keys)
    asked, bad = [], []
    for p, n in ((0, 20 if os.environ.get("CUTLAKE_ALL") else 6), (1, 4)):
        for seq in range(n):
            asked.append((p, rng.randrange(9), rng.randrange(2), rng.randint(0, 70), seq))
    crossed = set()
    for p, i, track, at, seq in asked:
        if i not in clips[p]:
            bad.append((p, i, seq, "ClipNotFound"))
            continue
        if clips[p][i]["track_id"] != track:
            crossed |= {(p, 0), (p, 1)}
        clips[p], held[p] = move_step(clips[p], held[p], i, track, at)
    assert bad and crossed
    moves = spark.createDataFrame([*asked, (2, 0, None, 5, 0)], "project_id bigint, clip_id bigint, new_track int, new_pts_in bigint, seq bigint")
    layered = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "-7 AS layer_order")
    tracks = spark.createDataFrame([(p, t, 3 - t) for p in range(3) for t in range(2)], "project_id bigint, track_id int, position int")
    done = edits.ripple_move(layered, moves, spark.createDataFrame(keys, KEYS), tracks)
    found = done.clips.collect()
    got = sorted(tuple(r[n] for n in NAMES) for r in found), sorted((r.project_id, r.clip_id, r.pts) for r in done.keyframes.collect())
    assert got == flat(clips, held)
    assert sorted((r.project_id, r.clip_id, r.seq, r.reason) for r in done.rejects.collect()) == sorted([*bad, (2, 0, 0, "MissingTarget")])
    for p in range(3):
        for t in range(2):
            mine = sorted((r.pts_in, r.clip_id, r.layer_order) for r in found if (r.project_id, r.track_id) == (p, t))
            assert [x[2] for x in mine] == ([(3 - t) * 256 + n for n in range(len(mine))] if (p, t) in crossed else [-7] * len(mine))


def test_new_pieces_are_numbered_without_the_other_clips(spark, monkeypatch):
    """Numbering reads its rows several times, so no join to all clips may stand in their plan."""
    plans, number = [], edits.new_ids

    def watched(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return number(rows, *rest)

    monkeypatch.setattr(edits, "new_ids", watched)
    clips = spark.createDataFrame(library(random.Random(5)), SCHEMA)
    moves = spark.createDataFrame([(p, p, 1, 30, s) for s, p in enumerate(range(6))], "project_id bigint, clip_id bigint, new_track int, new_pts_in bigint, seq bigint")
    assert edits.ripple_move(clips, moves).clips.count() >= clips.count()
    assert plans and not any("Join" in plan for plan in plans)
