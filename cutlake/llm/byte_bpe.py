"""Byte-level BPE by monoid tree reduction.

Encoding is a homomorphism up to seams: the ids of a pre-token come from encoding its halves,
recursively, and joining neighbours. A join re-encodes a window around the seam, one token to
each side at first, and doubles the window until its tokens fit the untouched ones outside.
Two tokens fit if their joined bytes encode to just the two of them; a sequence in which all
neighbours fit is the encoding of its bytes, so what lies outside a fitting window is stable.
Pre-tokens never merge with each other, so above them joining is concatenation. Decoding
concatenates the bytes of blocks of ids pairwise up the tree.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import Memo, per_worker, read, text_groups, text_or_empty, tokenizer_file

# Fixed value: the Unicode white space. A text may be cut before any run of it.
_WHITE_SET = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_PIECE = re.compile("[{0}]*[^{0}]+|[{0}]+".format("".join(sorted(_WHITE_SET))))
_NO_RANK = 1 << 60
_LEAF = 4
_REMEMBER = 16
_DECODE_LEAF = 4096


class TreeCodec:
    """Encoder and decoder over the ranks of a .tiktoken file.

    Short subtrees, windows and pieces are remembered, at most ``memo`` of each (and one
    text's more); a full memory is emptied before the next text.
    """

    def __init__(self, ranks_file: bytes, pattern: str, memo: int = 600_000):
        import regex

        lines = (line.split() for line in ranks_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.find = regex.compile(pattern).findall
        self.pieces, self.nodes, self.windows, self.seams = (Memo(memo) for _ in range(4))
        top = max(self.ranks.values()) + 1
        by_rank = [b""] * top
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.known_id = np.zeros(top, bool)
        self.known_id[list(self.ranks.values())] = True
        self.length = np.fromiter(map(len, by_rank), np.int64, top)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_rank), np.uint8)

    def merge(self, data: bytes) -> tuple[bytes, ...]:
        """The tokens of a few bytes: merge the lowest-ranked neighbours until none has a rank."""
        if len(data) > _REMEMBER:
            return self._merge_long(data)
        known = self.windows.get(data)
        if known is not None:
            return known
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        scores = [rank(a + b, _NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := min(scores)) != _NO_RANK:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], _NO_RANK)
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], _NO_RANK)
        found = self.windows[data] = tuple(parts)
        return found

    def _merge_long(self, data: bytes) -> tuple[bytes, ...]:
        """``merge`` with a heap of neighbours, for windows that had to grow."""
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))
        back = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n

        def score(at: int) -> int:
            after = end[at]
            return rank(data[at : end[after]], _NO_RANK) if after < n else _NO_RANK

        heap = [(r, at, at + 2) for at in range(n - 1) if (r := score(at)) != _NO_RANK]
        heapify(heap)
        while heap:
            _, at, stop = heappop(heap)
            if not alive[at] or end[at] >= n or end[end[at]] != stop:
                continue
            gone = end[at]
            alive[gone] = 0
            end[at] = stop
            if stop < n:
                back[stop] = at
            for start in (at, back[at]):
                if start >= 0 and (r := score(start)) != _NO_RANK:
                    heappush(heap, (r, start, end[end[start]]))
        found, at = [], 0
        while at < n:
            found.append(data[at : end[at]])
            at = end[at]
        return tuple(found)

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are side by side."""
        key = (left, right)
        known = self.seams.get(key)
        if known is None:
            known = self.seams[key] = self.merge(left + right) == key
        return known

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of two neighbouring byte strings from the encodings of each."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            keep, rest = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(left[keep:] + right[:rest]))
            if (keep == 0 or self.fits(left[keep - 1], window[0])) and (rest == len(right) or self.fits(window[-1], right[rest])):
                return left[:keep] + window + right[rest:]
            width *= 2

    def node(self, data: bytes) -> tuple[bytes, ...]:
        """The tokens of a subtree."""
        if len(data) <= _LEAF:
            return self.merge(data)
        known = self.nodes.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.node(data[:half]), self.node(data[half:]))
            if len(data) <= 2 * _LEAF:
                self.nodes[data] = known
        return known

    def piece(self, text: str) -> bytes:
        """Ids of a run of white space and the word behind it, as little-endian 32-bit numbers."""
        tokens = [token for match in self.find(text) for token in self.node(match.encode())]
        return array("I", map(self.ranks.__getitem__, tokens)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; its pieces are the leaves of the upper tree.

        Nearly all pieces are a single space and a word. They are looked up by the word; a
        word with white space at an end is kept as None, and sends its text the general way.
        """
        for memo in (self.pieces, self.nodes, self.windows, self.seams):
            memo.room(0)
        first, *words = text.split(" ")
        if first and first[-1] not in _WHITE_SET:
            try:
                return self._words(first, words)
            except TypeError:
                pass
        return b"".join(map(self.piece, _PIECE.findall(text)))

    def _words(self, first: str, words: list[str]) -> bytes:
        head = b"".join(map(self.piece, _PIECE.findall(first)))
        try:
            return head + b"".join(map(self.pieces.__getitem__, words))
        except KeyError:
            for word in set(words):
                if word not in self.pieces:
                    clean = word and word[0] not in _WHITE_SET and word[-1] not in _WHITE_SET
                    self.pieces[word] = b"".join(map(self.piece, _PIECE.findall(" " + word))) if clean else None
            return head + b"".join(map(self.pieces.__getitem__, words))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of blocks of ids, concatenated pairwise up the tree."""
        level = [self._block(ids[i : i + _DECODE_LEAF]) for i in range(0, len(ids), _DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""

    def _block(self, ids: np.ndarray) -> bytes:
        if not self.known_id[ids].all():
            raise ValueError("an id is not in the vocabulary")
        length = self.length[ids]
        shift = self.start[ids] - (np.cumsum(length) - length)
        return self.flat[np.repeat(shift, length) + np.arange(length.sum())].tobytes()


def _codec(ranks: Broadcast, pattern: str) -> TreeCodec:
    return per_worker("byte_bpe", ranks.value, lambda data: TreeCodec(data, pattern))


def _encode(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str, group: int) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks, pattern)
    for batch, texts in text_groups(batches, "text", group):
        found = [codec.encode(text) for text in texts]
        flat = pa.py_buffer(b"".join(found))
        ends, total = [0], 0
        for data in found:
            total += len(data) // 4
            ends.append(total)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), total, [None, flat]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(ranks, pattern)
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            ids = part.column("ids")
            flat, ends = ids.values.to_numpy(), ids.offsets.to_pylist()
            data = [codec.decode(flat[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, group_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, in one pass without a shuffle.

    Special tokens get no meaning. A null text counts as empty and has no ids; repeated rows
    and null doc_ids stay as they are; other columns are not read.
    """
    ranks = tokenizer_file(docs.sparkSession, ranks_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.mapInArrow(lambda batches: _encode(batches, ranks, pattern, group_bytes), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes (binary) of each row of ids. An unknown id is an error."""
    ranks = tokenizer_file(tokens.sparkSession, ranks_path)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(lambda batches: _decode(batches, ranks, pattern), f"doc_id {kind}, ids array<int>, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode(read(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    both = decode(ids, path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
