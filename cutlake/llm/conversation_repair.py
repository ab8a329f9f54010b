"""Cheapest repair of conversations: a Viterbi search backwards over chunks of turns, exact at chunk borders by fix-up passes.

A conversation is cut into chunks, which tasks work on apart. Walking a chunk backwards turns
the costs at its right end (one per state) into those at its left end. Each chunk first takes
the costs at its right end to be those at the end of a conversation. A fix-up pass then
reruns the chunks whose right neighbour arrived at other costs, and stops within a chunk as
soon as old and new costs differ by a constant only, for then the rest is the same. Edits
depend on differences alone, so constants are never carried on. Chunks that let every
difference through (all turns deleted, say) would pass news on one chunk a pass; after
MAX_PASSES their transfer matrices are multiplied by doubling instead.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cutlake.llm.common import SPACE, read, staged

# Undeleted turns of one chunk, and fix-up passes before matrices take over.
CHUNK = 4096
MAX_PASSES = 6

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: nothing yet, after system, after user, after assistant. An empty or complete conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT_BY = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# The state an inserted or re-roled turn leads to; its role follows from that.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
TERMINAL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}

Costs = tuple[int, int, int, int]


def _insertions(costs: list[int]) -> Costs:
    """Costs where turns may be inserted first."""
    u = min(costs[USER], INSERT + costs[ASSISTANT])
    a = min(costs[ASSISTANT], INSERT + u)
    return min(costs[START], INSERT + u), min(costs[SYSTEM], INSERT + u), u, a


def _before(after: Costs, code: str) -> Costs:
    """Least costs before a turn from those after it. ``code``: initial, '!' behind it if truncated."""
    extra = TRUNCATED if code.endswith("!") else 0
    kept = KEPT_BY.get(code[0], {})
    return _insertions(
        [min(DELETE + after[q], REROLE + extra + after[FORCED[q]], extra + after[kept[q]] if q in kept else FAR) for q in range(4)]
    )


@lru_cache(1 << 16)
def step(after: Costs, code: str) -> tuple[Costs, int]:
    """The same, less their least, and that."""
    costs = _before(after, code)
    low = min(costs)
    return tuple(c - low if c < FAR // 2 else FAR for c in costs), low


@lru_cache(1 << 16)
def choice(after: Costs, code: str, state: int) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits at a turn: letters (insertions first), the state behind, their cost."""
    extra = TRUNCATED if code.endswith("!") else 0
    kept = KEPT_BY.get(code[0], {})
    best = _before(after, code)
    letters, cost = "", 0
    while True:
        if DELETE + after[state] == best[state]:
            return letters + "D", state, cost + DELETE
        if INSERT + best[FORCED[state]] == best[state]:
            letters, state, cost = letters + "I", FORCED[state], cost + INSERT
        elif state in kept and extra + after[kept[state]] == best[state]:
            return letters + "K", kept[state], cost + extra
        else:
            return letters + "R", FORCED[state], cost + REROLE + extra


def backwards(codes: list[str], right: Costs) -> list[Costs]:
    """The costs at every turn of a chunk and, last, at its right end."""
    found = [right]
    for code in reversed(codes):
        found.append(step(found[-1], code)[0])
    return found[::-1]


def rerun(codes: list[str], old: Costs, new: Costs, left: Costs) -> Costs:
    """The costs at the left end for ``new`` at the right end, where ``old`` gave ``left``."""
    for code in reversed(codes):
        if old == new:
            return left
        old, new = step(old, code)[0], step(new, code)[0]
    return left if old == new else new


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults: conv_id, turn, role, text, copies and gone (the row was dropped)."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"), (fate == 0).alias("gone"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The columns of ``damage`` for conversations that are taken as they are; nulls are one space."""
    space = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"), F.lit(False).alias("gone"))


def _digest() -> Column:
    return F.when(~F.col("gone"), F.unhex(F.sha2("text", 256)))


def _turns(rows: DataFrame) -> DataFrame:
    """One narrow row per different turn of a conversation: no text, but its digest, faults and number of copies."""
    blank, cut = ~F.col("text").rlike(f"[^{SPACE}]"), ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    key = ["conv_id", "turn", "role", "digest", "blank", "cut", "gone"]
    role = F.when(~F.col("gone"), F.col("role"))
    flat = rows.select("conv_id", "turn", role.alias("role"), _digest().alias("digest"), blank.alias("blank"), cut.alias("cut"), "gone", "copies")
    turns = flat.groupBy(key).agg(F.sum("copies").alias("copies"))
    # Role and text seen earlier: only those that stand at two turns at least.
    seen = turns.where("not gone and not blank").groupBy("conv_id", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null")
    ).where("n > 1").select(F.col("conv_id").alias("seen_conv"), F.col("role").alias("seen_role"), F.col("digest").alias("seen_digest"), "first", "at_null")
    same = F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("role") == F.col("seen_role")) & (F.col("digest") == F.col("seen_digest"))
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("first"))), F.lit(False))
    return turns.join(seen, same, "left").select(*key, "copies", (later & ~F.col("blank")).alias("later"))


_CHUNKS = (
    "conv_id {id}, part int, seq bigint, starts boolean, ends boolean, turns array<bigint>, roles array<string>, digests array<binary>, "
    "codes array<string>, deleted array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, "
    "first_turn bigint, last_turn bigint, first_role string, last_role string"
)


class _Chunk:
    """A chunk as it fills: its undeleted turns, the deletions before each of them and behind the last, and its counts."""

    def __init__(self, conv_id: object, seq: int, starts: bool):
        self.row = {"conv_id": conv_id, "seq": seq, "starts": starts, "turns": [], "roles": [], "digests": [], "codes": [], "deleted": [0]}
        self.row |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        self.row |= dict.fromkeys(("first_turn", "last_turn", "first_role", "last_role"))

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, cut: bool, later: bool, copies: int) -> None:
        row, initial = self.row, role[:1]
        if row["first_role"] is None:
            row["first_role"] = initial
        else:
            row["illegal"] += row["last_role"] + initial not in LEGAL
        row["illegal"] += copies - 1
        row["last_role"] = initial
        if turn is not None and turn != row["last_turn"]:
            row["n_turns"] += 1
            row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
            row["last_turn"] = turn
        row["blank"] += copies if blank else 0
        row["duplicate"] += 0 if blank else copies - (not later)
        if blank or later:
            row["deleted"][-1] += copies
            return
        row["truncated"] += cut
        row["turns"].append(turn)
        row["roles"].append(role)
        row["digests"].append(digest)
        row["codes"].append((initial if initial in KEPT_BY else "-") + "!" * cut)
        row["deleted"].append(copies - 1)


def _chunks(turns: DataFrame) -> DataFrame:
    """Chunks of conversations in order of part and seq; starts and ends tell where the conversation surely does."""
    order = ["conv_id", "turn", "role", "digest"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, seq, done = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                new = chunk is None or row["conv_id"] != chunk.row["conv_id"]
                if new or len(chunk.row["codes"]) >= CHUNK:
                    if chunk is not None:
                        done.append(chunk.row | {"part": part, "ends": new})
                    chunk, seq = _Chunk(row["conv_id"], seq, new and chunk is not None), seq + 1
                if not row["gone"]:
                    chunk.add(row["turn"], row["role"], row["digest"], row["blank"], row["cut"], row["later"], row["copies"])
                if len(done) >= 512 or sum(len(x["codes"]) for x in done) > 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        if chunk is not None:
            yield pa.RecordBatch.from_pylist([*done, chunk.row | {"part": part, "ends": False}], schema)

    text = _CHUNKS.format(id=dict(turns.dtypes)["conv_id"])
    schema = to_arrow_schema(StructType.fromDDL(text))
    return placed.mapInArrow(build, text)


def _per_row(df: DataFrame, make, ddl: str) -> DataFrame:
    """``make`` of every row (a dict), as rows of ``ddl``."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                rows = [out for row in batch.slice(start, 32).to_pylist() for out in make(row)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return df.mapInArrow(run, ddl)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _neighbours(chunks: DataFrame, offset: int, *columns: str) -> DataFrame:
    """Columns of the chunk ``offset`` places on in the same conversation, named ``other_...``; null where there is none."""
    other = chunks.select((F.col("at") - offset).alias("other_at"), F.col("conv_id").alias("other_conv"), *[F.col(c).alias(f"other_{c}") for c in columns])
    return chunks.join(other, (F.col("at") == F.col("other_at")) & _same("conv_id", "other_conv"), "left")


def _at_borders(cut: DataFrame) -> tuple[DataFrame, int]:
    """``at`` (running number), conv_id and codes of the chunks that aren't a whole conversation for sure; the longest run of them."""
    # One count per task of the cutting job.
    counts = sorted(cut.groupBy("part").agg(F.max("seq") + 1).collect())
    base, total = [], 0
    for part, n in counts:
        base.append((part, total))
        total += n
    bases = cut.sparkSession.createDataFrame(base, "part int, base bigint")
    numbered = cut.where("not (starts and ends)").select("conv_id", "part", "seq", "codes").join(F.broadcast(bases), "part")
    borders = staged(numbered.select((F.col("base") + F.col("seq")).alias("at"), "part", "seq", "conv_id", "codes"), "border-chunks")
    longest = borders.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    return borders, longest or 0


def _right_costs(borders: DataFrame, longest: int) -> DataFrame:
    """at and right: the costs at the right end of each border chunk."""
    terminal = F.array(*map(F.lit, TERMINAL)).cast("array<bigint>")
    ddl = f"at bigint, conv_id {dict(borders.dtypes)['conv_id']}, right array<bigint>, left array<bigint>"

    def first(row: dict) -> list[dict]:
        return [{"at": row["at"], "conv_id": row["conv_id"], "right": TERMINAL, "left": backwards(row["codes"], TERMINAL)[0]}]

    def again(row: dict) -> list[dict]:
        left = rerun(row["codes"], tuple(row["right"]), tuple(row["wanted"]), tuple(row["left"]))
        return [{"at": row["at"], "conv_id": row["conv_id"], "right": row["wanted"], "left": left}]

    guesses = staged(_per_row(borders, first, ddl), "speculative-costs")
    for _ in range(MAX_PASSES):
        wanted = _neighbours(guesses, 1, "left").withColumn("wanted", F.coalesce("other_left", terminal))
        wrong = staged(wanted.where("right <> wanted").select("at", "right", "left", "wanted"), "wrong-costs")
        if wrong.isEmpty():
            return guesses.select("at", "right")
        mended = _per_row(wrong.join(borders.select("at", "conv_id", "codes"), "at"), again, ddl)
        guesses = staged(guesses.join(wrong.select("at"), "at", "left_anti").unionByName(mended), "mended-costs")
    return _by_matrices(borders, longest)


def _times(a: Column, b: Column) -> Column:
    """Product of two 4 by 4 matrices, row after row, where least stands for sum and sum for product."""
    entry = lambda i, j: F.least(*[F.get(a, F.lit(4 * i + k)) + F.get(b, F.lit(4 * k + j)) for k in range(4)])
    return F.array(*[F.least(entry(i, j), F.lit(FAR)) for i in range(4) for j in range(4)])


def _by_matrices(borders: DataFrame, longest: int) -> DataFrame:
    """The same by doubling: in each round every chunk's matrix takes in as many chunks to the right again."""

    def matrix(row: dict) -> list[dict]:
        columns = []
        for end in range(4):
            costs = tuple(0 if q == end else FAR for q in range(4))
            total = 0
            for code in reversed(row["codes"]):
                costs, low = step(costs, code)
                total += low
            columns.append([c + total if c < FAR else FAR for c in costs])
        return [{"at": row["at"], "conv_id": row["conv_id"], "m": [columns[j][i] for i in range(4) for j in range(4)]}]

    ddl = f"at bigint, conv_id {dict(borders.dtypes)['conv_id']}, m array<bigint>"
    products = staged(_per_row(borders, matrix, ddl), "chunk-matrices")
    reach = 1
    while reach < longest:
        joined = _neighbours(products, reach, "m").select("at", "conv_id", F.when(F.col("other_m").isNull(), F.col("m")).otherwise(_times(F.col("m"), F.col("other_m"))).alias("m"))
        products, reach = staged(joined, "chunk-matrices"), 2 * reach
    # What lies to the right of a chunk, applied to the costs at the end.
    cost = lambda i: F.least(*[F.get("other_m", F.lit(4 * i + k)) + TERMINAL[k] for k in range(4)])
    costs = F.when(F.col("other_m").isNull(), F.array(*map(F.lit, TERMINAL)).cast("array<bigint>")).otherwise(F.array(*map(cost, range(4))))
    found = _neighbours(products, 1, "m").select("at", costs.alias("c"))
    return staged(found.select("at", F.transform("c", lambda x: x - F.array_min("c")).alias("right")), "right-costs")


def _start_states(borders: DataFrame, right: DataFrame, longest: int) -> DataFrame:
    """at and state: the state in which tracing enters each border chunk, by composing their maps of states."""
    ddl = f"at bigint, conv_id {dict(borders.dtypes)['conv_id']}, ends array<int>"

    def maps(row: dict) -> list[dict]:
        costs = backwards(row["codes"], tuple(row["right"]))
        ends = list(range(4))
        for after, code in zip(costs[1:], row["codes"], strict=True):
            ends = [choice(after, code, q)[1] for q in ends]
        return [{"at": row["at"], "conv_id": row["conv_id"], "ends": ends}]

    found = staged(_per_row(borders.select("at", "conv_id", "codes").join(right, "at"), maps, ddl), "chunk-maps")
    reach = 1
    while reach < longest:
        joined = _neighbours(found, -reach, "ends")
        found = staged(joined.select("at", "conv_id", F.coalesce(F.transform("other_ends", lambda q: F.get("ends", q)), "ends").alias("ends")), "chunk-maps")
        reach *= 2
    return _neighbours(found, -1, "ends").select("at", F.coalesce(F.get("other_ends", F.lit(START)), F.lit(START)).alias("state"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
_EDGES = ("first_turn", "last_turn", "first_role", "last_role")
_EDITS = (
    "conv_id {id}, section int, at bigint, turn bigint, role string, digest binary, kind int, new_role string, inserted string, audit string, cost bigint, "
    + ", ".join(f"{c} bigint" for c in (*_COUNTS, *_EDGES[:2])) + ", " + ", ".join(f"{c} string" for c in _EDGES[2:])
)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of all conversations, as narrow rows.

    ``rows`` has the columns of ``damage``. Section 0 has one row per chunk with its audit
    letters, cost and counts; section 1 one per turn that stays, by its old turn, role and
    text digest, with its new role and the turns inserted before it ('u', 'a'); section 2
    what is inserted behind the last turn. Turns of a conversation go by turn (nulls first),
    then role, then SHA-256 of the text.
    """
    cut = staged(_chunks(staged(_turns(rows), "turns")), "chunks")
    borders, longest = _at_borders(cut)
    right = _right_costs(borders, longest)
    starts = _start_states(borders, right, longest)
    is_last = _neighbours(borders.select("at", "conv_id", "part", "seq"), 1).select("part", "seq", "at", F.col("other_at").isNull().alias("is_last"))
    known = is_last.join(right, "at").join(starts, "at")
    chunk = cut.join(known, ["part", "seq"], "left")
    terminal = F.array(*map(F.lit, TERMINAL)).cast("array<bigint>")
    chunk = chunk.withColumns({
        "right": F.coalesce("right", terminal), "state": F.coalesce("state", F.lit(START)), "is_last": F.coalesce("is_last", F.lit(True)), "at": F.coalesce("at", F.lit(-1)),
    })
    return staged(_per_row(chunk, _trace, _EDITS.format(id=dict(rows.dtypes)["conv_id"])), "edits")


def _trace(row: dict) -> Iterator[dict]:
    codes = row["codes"]
    costs = backwards(codes, tuple(row["right"]))
    state, total = row["state"], DELETE * sum(row["deleted"])
    audit = ["D" * row["deleted"][0]]
    for i, code in enumerate(codes):
        letters, after, cost = choice(costs[i + 1], code, state)
        audit.append(letters + "D" * row["deleted"][i + 1])
        total += cost
        inserted = _inserted(state, len(letters) - 1)
        if inserted or letters != "D":
            new = {"K": row["roles"][i], "R": ROLE_OF.get(after)}.get(letters[-1])
            yield {
                "conv_id": row["conv_id"], "section": 1, "at": 0, "turn": row["turns"][i], "role": row["roles"][i], "digest": row["digests"][i], "kind": 0,
                "new_role": new, "inserted": inserted,
            }
        state = after
    if row["is_last"]:
        n = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
        audit.append("I" * n)
        total += INSERT * n
        if n:
            yield {"conv_id": row["conv_id"], "section": 2, "at": 0, "kind": 0, "inserted": _inserted(state, n)}
    yield {"conv_id": row["conv_id"], "section": 0, "at": row["at"], "kind": 0, "audit": "".join(audit), "cost": total} | {c: row[c] for c in (*_COUNTS, *_EDGES)}


def _inserted(state: int, n: int) -> str:
    roles = ""
    for _ in range(n):
        state = FORCED[state]
        roles += ROLE_OF[state][0]
    return roles


Event = namedtuple("Event", "kind conv_id row")


def _merge(rows: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """Edits and the texts they are about, each conversation in one task and in order.

    Only turns with something to say travel, each text once. Tasks read their conversations as
    a stream, so one of any length needs no memory; its hash can't be had without reading it
    from front to back.
    """
    texts = rows.where(~F.col("gone") & F.col("text").rlike(f"[^{SPACE}]")).select(
        "conv_id", F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("at"), "turn", "role", _digest().alias("digest"), F.lit(1).alias("kind"), "text"
    )
    order = ["conv_id", "section", "at", "turn", "role", "digest", "kind"]
    return edit_rows.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)


def _events(batches: Iterable[pa.RecordBatch]) -> Iterator[Event]:
    """Chunks, repaired lines and ends of conversations, in order."""
    conv, begun, waiting = None, False, None
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for row in batch.slice(start, 1024).to_pylist():
                if begun and row["conv_id"] != conv:
                    yield Event("end", conv, None)
                conv, begun = row["conv_id"], True
                key = (conv, row["turn"], row["role"], row["digest"])
                if row["section"] == 0:
                    yield Event("chunk", conv, row)
                elif row["kind"] == 0:
                    for initial in row["inserted"]:
                        yield Event("line", conv, ("user" if initial == "u" else "assistant", ""))
                    waiting = (key, row["new_role"]) if row["new_role"] is not None else None
                elif waiting is not None and waiting[0] == key:
                    yield Event("line", conv, (waiting[1], row["text"]))
                    waiting = None
    if begun:
        yield Event("end", conv, None)


def repaired_turns(rows: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations; ``rows`` as in ``edits``."""
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, place bigint, role string, text string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place = [], 0, 0
        for event in _events(batches):
            if event.kind == "end":
                place = 0
            elif event.kind == "line":
                held.append({"conv_id": event.conv_id, "place": place, "role": event.row[0], "text": event.row[1]})
                place, size = place + 1, size + len(event.row[1])
                if size > 4 << 20 or len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return _merge(rows, edit_rows).mapInArrow(run, ddl)


class _Report:
    """What one conversation adds up to."""

    def __init__(self) -> None:
        self.hash, self.lines, self.audit = hashlib.sha256(), 0, []
        self.counts = dict.fromkeys((*_COUNTS, "cost"), 0)
        self.first_turn = self.last_turn = self.last_role = None

    def line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def chunk(self, row: dict) -> None:
        self.audit.append(row["audit"])
        for name in self.counts:
            self.counts[name] += row[name]
        if row["first_role"] is not None:
            if self.last_role is not None:
                self.counts["illegal"] += self.last_role + row["first_role"] not in LEGAL
            self.last_role = row["last_role"]
        if row["first_turn"] is not None:
            if self.last_turn is not None:
                self.counts["n_turns"] -= self.last_turn == row["first_turn"]
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def row(self, conv_id: object) -> dict:
        gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.counts["n_turns"]
        found = {"conv_id": conv_id, "gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}
        return found | {c: self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}


def report(rows: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and letters of its edits, and a hash of what it becomes.

    ``rows`` as in ``edits``; a conversation all of whose rows are gone has zeros, an empty
    audit and the hash of nothing. Rows with a null conv_id are one conversation. A role
    without any character has no initial and can't be kept. Repeated rows are duplicates of
    each other; an empty table gives no rows; other columns are not read.
    """
    ddl = (
        f"conv_id {dict(rows.dtypes)['conv_id']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string"
    )
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, _Report()
        for event in _events(batches):
            if event.kind == "chunk":
                now.chunk(event.row)
            elif event.kind == "line":
                now.line(*event.row)
            else:
                held.append(now.row(event.conv_id))
                size, now = size + len(held[-1]["audit"]), _Report()
                if size > 4 << 20 or len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return _merge(rows, edit_rows).mapInArrow(run, ddl)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and repaired hash of every conversation after damage."""
    rows = damage(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return report(rows, edits(rows))
