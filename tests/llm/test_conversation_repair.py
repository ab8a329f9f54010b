import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cutlake.llm import conversation_repair as cr

from .conftest import DATA

ROWS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def _model(original, rows):
    """Every conversation by itself, front to back, trying all edits at every place."""
    found = {}
    for conv in {r[0] for r in original}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserted=0, mine=tuple(mine), faults=tuple(faults)):
            options = []
            if inserted < 3:
                role = "a" if state == "u" else "u"
                cost, letters, lines = best(i, role, inserted + 1)
                options.append((cost + 3, "I" + letters, (("user" if role == "u" else "assistant") + ":",) + lines))
            if i == len(mine):
                return min(options + ([(0, "", ())] if state in ("", "a") else []), default=(10**9, "", ()))
            _, _, role, text = mine[i]
            cost, letters, lines = best(i + 1, state)
            options.append((cost + 4, "D" + letters, lines))
            extra = 3 if faults[i] == "truncated" else 0
            if faults[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in NEXT:
                    cost, letters, lines = best(i + 1, NEXT[state, role[:1]])
                    options.append((cost + extra, "K" + letters, (f"{role}:{text}",) + lines))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        cost, letters, lines = best(i + 1, new[0])
                        options.append((cost + 3 + extra, "R" + letters, (f"{new}:{text}",) + lines))
            return min(options, key=lambda x: x[:2])

        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = best(0, "")
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _found(frame):
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def _report(frame, prepare=cr.damage):
    rows = prepare(frame)
    return cr.report(rows, cr.edits(rows))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _found(cr.op11_conversation_repair(spark, DATA)) == _model(rows, _damaged(rows))


def _odd_rows(seed, n=500):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "Why? ", " \n", "", None, "x" * 3000 + ".", "é?\t", "a: b\nc."]
    return [(rng.choice([1, 2, 3, 4, 5, None, 7]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_odd_rows(spark):
    rows = _odd_rows(5)
    rows += rows[:40] + [(100, None, None, None), (101, 5, "user", "Only."), (102, -3, "assistant", "x."), (102, 9, "user", "y")]
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as part", "2 as seq", "3 as copies", "4 as `a.b`", "5 as at")
    assert _found(_report(frame)) == _model(rows, _damaged(rows))
    assert _report(frame.limit(0)).count() == 0


def test_all_rows_of_a_conversation_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = _found(_report(spark.createDataFrame([(gone, 0, "user", "Hello.")], ROWS)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("passes", [0, 1, 6])
def test_conversations_over_many_chunks(spark, monkeypatch, passes):
    """Chunks of three turns: hot conversations, and ones whose chunks let every difference through."""
    monkeypatch.setattr(cr, "CHUNK", 3)
    monkeypatch.setattr(cr, "MAX_PASSES", passes)
    rng = random.Random(passes)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Text %d.", "cut %d"]) % i) for i in range(150)]
    rows += [(2, i, "tool", f"cut {i}") for i in range(60)] + [(2, 60, "user", "Last."), (2, 61, "tool", "cut")]
    rows += [(3, i, "user", "Same.") for i in range(50)] + [(4, i, ["user", "assistant"][i % 2], f"Fine {i}.") for i in range(40)]
    rows += [(5, i // 4, rng.choice(["user", "assistant"]), f"Turn {i // 9}?") for i in range(60)]
    found = _found(_report(spark.createDataFrame(rows, ROWS).repartition(8), cr.undamaged))
    assert found == _model(rows, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (2, 0, "user", "Q?"), (2, 1, "user", "Q?"), (2, 2, "assistant", "R.")]
    damaged = cr.undamaged(spark.createDataFrame(rows, ROWS))
    found = sorted(map(tuple, cr.repaired_turns(damaged, cr.edits(damaged)).collect()))
    assert found == [
        (1, 0, "system", "S."), (1, 1, "user", ""), (1, 2, "assistant", "A."), (1, 3, "user", "U."), (1, 4, "assistant", ""),
        (2, 0, "user", "Q?"), (2, 1, "assistant", "R."),
    ]
