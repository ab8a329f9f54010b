"""Conflict-constrained best-fit packing of documents into training sequences.

A text of more than a sequence is cut into full sequences and a remainder. Remainders, and
shorter texts, are packed, the longest first, into bins that hold at most one piece of a
source and one of a group of copies. Open bins are kept in order of their free room; each
carries a bitmap of its sources and one of its groups. The search starts at the first room
that fits and goes on to the next until a bin has neither bit set: the tightest compatible
one. A tree over the rooms holds, for every stretch of it, the sources that all its bins
have, so stretches that a hot source has filled are stepped over at once.

Documents are dealt to shards of about ``SHARD_ROWS`` by a hash of id and text, so neither a
hot source nor a large group of copies gathers in one task; each shard packs by itself.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import read, staged

CAPACITY = 2048
SHARD_ROWS = 8192
_ALL = -1
_NOTHING = 1


class Bins:
    """Open bins by free room, with successor search."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << (capacity + 1).bit_length()
        # common[node]: sources that every bin below the node has; all of them, and the bit of
        # _NOTHING that no bin has, where there is no bin.
        self.common = [_ALL] * (2 * self.leaves)
        self.at: dict[int, list[int]] = defaultdict(list)
        self.free: list[int] = []
        self.sources: list[int] = []
        self.groups: list[int] = []

    def _refresh(self, room: int) -> None:
        node = self.leaves + room
        value = _ALL
        for one in self.at[room]:
            value &= self.sources[one]
        while True:
            if self.common[node] == value:
                return
            self.common[node] = value
            if node == 1:
                return
            node >>= 1
            value = self.common[2 * node] & self.common[2 * node + 1]

    def _next_room(self, room: int, source: int) -> int | None:
        """The first room from ``room`` on where some bin lacks the source."""
        source |= _NOTHING
        node = self.leaves + room
        while True:
            if not self.common[node] & source:
                while node < self.leaves:
                    node *= 2
                    if self.common[node] & source:
                        node += 1
                return node - self.leaves
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1

    def _tightest(self, size: int, source: int, group: int) -> int | None:
        room = self._next_room(size, source)
        while room is not None:
            for one in self.at[room]:
                if not (self.sources[one] & source or self.groups[one] & group):
                    return one
            room = self._next_room(room + 1, source)
        return None

    def place(self, size: int, source: int, group: int) -> tuple[int, int]:
        """Bin and offset of a piece; ``source`` and ``group`` have one bit set, or none."""
        one = self._tightest(size, source, group)
        if one is None:
            one = len(self.free)
            self.free.append(self.capacity)
            self.sources.append(0)
            self.groups.append(0)
        else:
            self.at[self.free[one]].remove(one)
            self._refresh(self.free[one])
        offset = self.capacity - self.free[one]
        self.free[one] -= size
        self.sources[one] |= source
        self.groups[one] |= group
        insort(self.at[self.free[one]], one)
        self._refresh(self.free[one])
        return one, offset


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs twice or more; none for the rest, which conflict with nothing."""
    seen: dict = {}
    count = defaultdict(int)
    for value in values:
        count[value] += 1
    return [2 << seen.setdefault(value, len(seen)) if value is not None and count[value] > 1 else 0 for value in values]


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """One shard: its pieces with their bins."""
    rows = table.to_pylist()
    pieces = []
    for row in rows:
        whole, rest = divmod(row["size"], capacity)
        pieces += [(row, part, capacity) for part in range(whole)]
        if rest or not whole:
            pieces.append((row, whole, rest))
    pieces.sort(key=lambda p: (-p[2], p[0]["doc_id"] is None, p[0]["doc_id"] or 0, p[0]["mark"], p[1]))
    sources = _bits([p[0]["source"] for p in pieces])
    groups = _bits([p[0]["group"] for p in pieces])
    bins = Bins(capacity)
    out = {name: [] for name in ("doc_id", "part", "size", "first", "shard", "bin", "offset")}
    for (row, part, size), source, group in zip(pieces, sources, groups, strict=True):
        if size == capacity:
            # A full sequence shares its bin with nothing.
            one, offset = len(bins.free), 0
            bins.free.append(0)
            bins.sources.append(source)
            bins.groups.append(group)
        else:
            one, offset = bins.place(size, source, group)
        for name, value in zip(out, (row["doc_id"], part, size, part * capacity, row["shard"], one, offset), strict=True):
            out[name].append(value)
    kinds = {"doc_id": table.schema.field("doc_id").type, "shard": pa.int32(), "part": pa.int32(), "bin": pa.int32()}
    return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()})


def estimated_tokens(text: Column) -> Column:
    """A token for every four UTF-8 bytes begun."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def pack(docs: DataFrame, size: Column, group: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, part, size, first, shard, bin and offset of every piece of every row.

    ``size`` is the length of a row; ``group`` tells copies (by default rows of equal text); both
    are columns of ``docs``. Within a bin no two pieces share a source or a group; null
    sources and groups conflict with nothing, null and empty texts only take a place. Repeated
    rows are pieces of their own. The layout depends on the rows alone, not on their order.
    Only doc_id, text, source and what the two columns name are read.
    """
    groups = F.when(F.length("text") > 0, F.xxhash64("text")) if group is None else group
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), groups.alias("group"), F.xxhash64("text").alias("mark"))
    rows = staged(rows, "packing-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("*", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(shards)).cast("int").alias("shard"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(
        lambda table: _pack(table, capacity), f"doc_id {kind}, part int, size long, first long, shard int, bin int, offset long"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 estimated tokens."""
    return pack(read(spark, sf_dir, "documents", "doc_id", "text", "source"), estimated_tokens(F.col("text")))
