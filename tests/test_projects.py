"""Project documents there and back."""

import json

import pytest

from cutlake.sources.projects import read_projects, write_projects


def document(project, n):
    """Every member a document may have, and some that no version knows yet."""
    pin = {"tl": [0.0, 0.5], "tr": [1.0, 0.0], "enabled": True}
    return {
        "format_version": 1, "project_id": project, "name": 'A "quoted" näme',
        "settings": {"width": 1920, "height": 1080, "frame_rate": {"num": 30000, "den": 1001}, "timebase": {"num": 1, "den": 90000}, "colour": "P3"},
        "tracks": {
            "tracks": [
                {"id": 1, "kind": "Video", "name": "V1", "mute": False, "solo": True, "locked": False, "gain": 1.0, "pan": 0.0, "height_px": 64},
                {"id": 2, "kind": {"Audio": {"sample_rate": 48000, "channels": 2}}, "name": "A1", "mute": True, "solo": False, "locked": True, "gain": 0.5, "pan": -0.25, "height_px": 48},
            ],
            "next_id": 3,
        },
        "clips": {
            "ids": list(range(n)), "track_ids": [1 + i % 2 for i in range(n)], "source_ids": [7] * n, "pts_in": [100 * i for i in range(n)],
            "pts_out": [100 * i + 90 for i in range(n)], "source_in": [5] * n,
            "kind": ["Video" if i % 2 else {"Text": {"text": 'x }{ "y"', "font_size": 12.5, "color": [1.0, 0.5, 0.0, 1.0], "stroke_color": None}} for i in range(n)],
            "layer_order": [i for i in range(n)], "opacity": [0.5] * n, "volume": [1.0] * n, "pan": [0.0] * n, "audio_muted": [bool(i % 2) for i in range(n)],
            "fade_in_pts": [3] * n, "fade_out_pts": [4] * n, "speed": [2.0] * n, "pitch": [-1.5] * n, "blend_mode": ["Screen"] * n, "matte_mode": ["None"] * n,
            "transform": [{"position": [1.0, 2.0], "scale": [1.0, 1.0], "rotation": 45.0, "anchor": [0.5, 0.5]}] * n,
            "crop": [{"left": 0.1, "top": 0.0, "right": 0.0, "bottom": 0.2, "feather": 0.0}] * n,
            "corner_pin": [pin if i else None for i in range(n)], "effects": [{"effects": [{"kind": "Blur", "enabled": True, "params": [1.5, i]}]} for i in range(n)],
            "effect_start": [i for i in range(n)], "effect_count": [2] * n, "label": [None if i == 1 else f"c{i}" for i in range(n)], "next_id": n,
            "keyframes": {"tracks": [{"clip_id": 0, "param": "Opacity", "keys": [{"pts": 1, "value": 0.5, "interp": "Linear"}, {"pts": 9, "value": 1.0, "interp": "Hold"}]}] if n else []},
        },
        "sources": {
            "ids": [7, 9], "paths": ["/m/a b.mov", "/m/é.wav"], "proxy_ids": [9, None], "video_info": [{"width": 3840, "rate": {"num": 25, "den": 1}}, None],
            "audio_info": [None, {"channels": 2}], "hash": ["x", 5], "next_id": 10,
        },
        "window": {"zoom": 1.5, "open": ["a", None]}, "theme": "dark",
    }


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for project, n in ((1, 4), (2, 1), (3, 0)):
        (tmp_path / "in" / f"{project}.json").write_text(json.dumps(document(project, n), indent=1))
    (tmp_path / "in" / "broken.json").write_text('{"format_version": 1, "clips": {"ids": [1')
    (tmp_path / "in" / "newer.json").write_text(json.dumps({**document(4, 1), "format_version": 2}))
    return tmp_path


def test_full_round_trip(spark, folder):
    tables = read_projects(spark, str(folder / "in"))
    assert sorted(r.reason for r in tables["rejects"].collect()) == ["NewerFormat", "Unreadable"]
    assert write_projects(tables, str(folder / "out")).count() == 0
    back = [json.loads(f.read_text()) for f in (folder / "out").rglob("*.txt") if f.stat().st_size]
    assert {d["project_id"]: d for d in back} == {i: _expected(document(i, n)) for i, n in ((1, 4), (2, 1), (3, 0))}


def _expected(doc):
    # Lists without elements show no more what they were lists of.
    if not doc["clips"]["ids"]:
        del doc["clips"]["label"]
    return doc


def test_rows_without_a_project_come_back(spark, folder):
    tables = read_projects(spark, str(folder / "in"))
    orphans = write_projects({**tables, "projects": tables["projects"].where("project_id <> 1")}, str(folder / "out"))
    assert sorted(map(tuple, orphans.collect())) == [(1, p, n, "NoProject") for p, n in (("clips", 4), ("keyframes", 2), ("sources", 2), ("tracks", 2))]
    assert len([f for f in (folder / "out").rglob("*.txt") if f.stat().st_size]) == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(1, 5)))
    plan = _plan(read_projects(spark, str(tmp_path))["clips"])
    assert plan.count("from_json(") == 1
    # Members of the section are taken apart once, before one map per clip is made of them.
    assert plan.count("$.clips") == 1 and "$.clips" in next(line for line in plan.splitlines() if "explode(" in line)


def test_orphans_are_counted_without_their_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(document(1, 5)))
    tables = read_projects(spark, str(tmp_path / "in"))
    tables = {**tables, "projects": tables["projects"].where("project_id = 2")}
    lost = write_projects({k: v for k, v in tables.items() if k != "rejects"}, str(tmp_path / "out"))
    assert "collect_list" not in _plan(lost)
    want = {name: tables[name].count() for name in ("clips", "tracks", "sources", "keyframes")}
    assert {tuple(r) for r in lost.collect()} == {(1, part, n, "NoProject") for part, n in want.items() if n}
