"""Token counts by rank-synchronous array merging.

The vocabulary is that of a sentencepiece BPE model. Text becomes pre-tokens, each a run of
spaces and the word behind it; no piece reaches from a letter over to a later space, so no
merge crosses. A batch of new pre-tokens is held as one ragged numpy array of symbols. In
each round every sequence finds its lowest-ranked pair and all of them merge at once. Where
the merged piece only takes part in merges of higher rank, its other places in the sequence
merge in the same round; else only the leftmost does, which is the library's order. What
is left of a sequence when no pair has a rank is its count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import Memo, per_worker, read, text_groups, text_or_empty, tokenizer_file

_NONE = np.int64(1) << 60
_PRE_TOKEN = re.compile(" *[^ ]+| +")


class MergeTable:
    """Pairs of symbol ids and what they merge to, as sorted arrays."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        ids = [i for i in range(len(pieces)) if not any(test(i) for test in special)]
        self.ids = {pieces[i]: i for i in ids}
        self.size = len(pieces)
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        joins = [
            (self.ids[piece[:k]], self.ids[piece[k:]], self.ids[piece])
            for piece in self.ids
            for k in range(1, len(piece))
            if piece[:k] in self.ids and piece[k:] in self.ids
        ]
        left, right, whole = np.array(joins, np.int64).T
        key = left * self.size + right
        order = np.argsort(key)
        self.key, self.whole = key[order], whole[order]
        # A piece may merge everywhere at once if every merge it takes part in comes later.
        self.everywhere = np.ones(self.size, bool)
        for part in (left, right):
            self.everywhere[part[self.rank[whole] <= self.rank[part]]] = False
        self.chars = {piece: i for piece, i in self.ids.items() if len(piece) == 1}
        # Neighbours that no piece holds side by side can never be in one token.
        inside = sorted({piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)})
        self.neighbours = np.array(sorted((ord(x[0]) << 32) | ord(x[1]) for x in inside), np.int64)
        if any(re.search("[^\u2581]\u2581", piece) for piece in self.ids):
            raise ValueError("a piece holds a space behind a letter; words can't be counted apart")

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece of each pair and its rank; -1 and a huge rank where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = (self.key[at] == key) & (left >= 0) & (right >= 0)
        whole = np.where(known, self.whole[at], -1)
        return whole, np.where(known, self.rank[whole], _NONE)

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token, spaces written as U+2581."""
        if not pre_tokens:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        code = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(pre_tokens)), lengths)
        distinct, where = np.unique(code, return_inverse=True)
        symbol = np.array([self.chars.get(chr(c), -1) for c in distinct], np.int64)[where]
        # An unknown character falls back to its UTF-8 bytes.
        weight = np.where(symbol >= 0, 1, np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4))
        total = np.bincount(owner, weights=weight, minlength=len(pre_tokens)).astype(np.int64)
        near = (code[:-1] << 32) | code[1:]
        at = np.minimum(np.searchsorted(self.neighbours, near), len(self.neighbours) - 1)
        cut = np.ones(len(code), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (self.neighbours[at] != near)
        self._merge_all(symbol, np.cumsum(cut) - 1, owner, total)
        return total

    def _merge_all(self, symbol: np.ndarray, seq: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
        """Merge until no pair has a rank, taking each merge off the total of its owner."""
        whole, rank = self._pairs_at(symbol, seq, np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[start, len(seq)])
            lowest = np.minimum.reduceat(rank, start)
            if (done := lowest == _NONE).any():
                keep = np.repeat(~done, length)
                symbol, seq, owner, whole, rank = symbol[keep], seq[keep], owner[keep], whole[keep], rank[keep]
                continue
            hit = self._together(np.flatnonzero(rank == np.repeat(lowest, length)), seq, whole)
            symbol[hit] = whole[hit]
            np.subtract.at(total, owner[hit], 1)
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            symbol, seq, owner, whole, rank = symbol[keep], seq[keep], owner[keep], whole[keep], rank[keep]
            for at in (new, new[new > 0] - 1):
                whole[at], rank[at] = self._pairs_at(symbol, seq, at)

    def _together(self, hit: np.ndarray, seq: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Of the places with the lowest rank of their sequence, those that merge in this round."""
        first = np.r_[True, seq[hit][1:] != seq[hit][:-1]]
        group = np.cumsum(first) - 1
        leader = whole[hit][first]
        free = self.everywhere[leader]
        free[group[whole[hit] != leader[group]]] = False
        # Of places side by side every second one merges, from the left.
        run = np.flatnonzero(first | np.r_[True, np.diff(hit) > 1])
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
        return hit[first | (free[group] & (place % 2 == 0))]

    def _pairs_at(self, symbol: np.ndarray, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbol) - 1)
        inside = (after > at) & (seq[after] == seq[at])
        return self.merges(symbol[at], np.where(inside, symbol[after], -1))


def _count(batches: Iterator[pa.RecordBatch], model: Broadcast, group: int, memo: int) -> Iterator[pa.RecordBatch]:
    table, known = per_worker("token_counts", model.value, lambda data: (MergeTable(data), Memo(memo)))
    for batch, texts in text_groups(batches, "text", group):
        words = [_PRE_TOKEN.findall(" " + text.replace("\u2581", " ")) if text else [] for text in texts]
        distinct = set().union(*words)
        known.room(len(distinct))
        new = [word for word in distinct if word not in known]
        known.update(zip(new, table.counts([word.replace(" ", "\u2581") for word in new]).tolist(), strict=True))
        sums = [sum(map(known.__getitem__, found)) for found in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )


def token_counts(docs: DataFrame, model_path: str, group_bytes: int = 2 << 20, memo_entries: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they
    are; other columns are not read. ``group_bytes`` of text are counted at a time, and a
    worker remembers the counts of at most ``memo_entries`` pre-tokens.
    """
    model = tokenizer_file(docs.sparkSession, model_path)
    texts = docs.select("doc_id", text_or_empty().alias("text")).select("*", F.octet_length("text").cast("long").alias("n_bytes"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return texts.mapInArrow(lambda batches: _count(batches, model, group_bytes, memo_entries), schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and which are over 4,096 tokens."""
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
