"""A static range asymmetric numeral system over token ids.

One frequency table, scaled to 2^SCALE, serves all blocks. Inside a block the ids are dealt
to lanes like cards; lane states are numpy arrays, so a step codes one id in every lane. A
block carries its own header and needs no other block. After every ``STRIDE`` steps it
holds a checkpoint - the lanes' states and the place in the word stream - with the CRC-32 of
the ids up to the next one, so segments can be decoded and checked apart.

Layout, little-endian: magic, n_ids, n_lanes, n_segments, n_words (5 x u32); per segment
crc32 and first word (2 x u32) and the lanes' states (u64 each); then the words (u32).
"""

from __future__ import annotations

import zlib

import numpy as np

# Fixed values of the format.
MAGIC = 0x31534E52
SCALE = 20
STRIDE = 256
MAX_LANES = 1024
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, 1 at least for every id that occurs."""
    total, size = int(counts.sum()), 1 << SCALE
    used = counts > 0
    if not total:
        return np.zeros(len(counts), np.uint32)
    if used.sum() > size:
        raise ValueError("more different ids than the scale has room for")
    spare = size - int(used.sum())
    share = counts / total * spare
    freq = np.where(used, 1 + np.floor(share).astype(np.int64), 0)
    left = size - int(freq.sum())
    # Rounding leaves fewer places than ids; the largest fractions get them, ties to the smaller id.
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)) * used, ~used))
    freq[order[:left]] += 1
    return freq.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(MAX_LANES, n // 64))
    steps = -(-n // lanes)
    limit = (_LOW >> np.uint64(SCALE)) << _WORD
    state = np.full(lanes, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    written = 0
    segments: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        row = ids[step * lanes : (step + 1) * lanes]
        freq, start = table.freq[row], table.start[row]
        x = state[: len(row)]
        full = x >= limit * freq
        if full.any():
            chunks.append((x[full] & _MASK32).astype(np.uint32))
            written += len(chunks[-1])
            x = np.where(full, x >> _WORD, x)
        whole = x // freq
        state[: len(row)] = (whole << np.uint64(SCALE)) + (x - whole * freq) + start
        if step % STRIDE == 0:
            segments.append((written, state.copy()))
    segments.reverse()
    head = [np.array([MAGIC, n, lanes, len(segments), written], "<u4").tobytes()]
    for k, (place, states) in enumerate(segments):
        crc = zlib.crc32(ids[k * STRIDE * lanes : (k + 1) * STRIDE * lanes].astype("<u4").tobytes())
        head += [np.array([crc, written - place], "<u4").tobytes(), states.astype("<u8").tobytes()]
    # The decoder meets the words in the opposite order.
    return b"".join(head + [chunk.astype("<u4").tobytes() for chunk in reversed(chunks)])


def decode(block: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one of its segments; a wrong checksum is an error."""
    magic, n, lanes, count, n_words = (int(v) for v in np.frombuffer(block, "<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    width = 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, 20 + count * width).astype(np.uint64)
    out = np.zeros(n, np.uint32)
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for k in range(count) if segment is None else [segment]:
        crc, at = (int(v) for v in np.frombuffer(block, "<u4", 2, 20 + k * width))
        state = np.frombuffer(block, "<u8", lanes, 28 + k * width).astype(np.uint64)
        first = k * STRIDE * lanes
        stop = min(n, first + STRIDE * lanes)
        for i in range(first, stop, lanes):
            size = min(lanes, n - i)
            x = state[:size]
            slot = x & mask
            symbol = table.slots[slot.astype(np.int64)]
            out[i : i + size] = symbol
            x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _WORD) | words[at : at + len(low)]
                at += len(low)
            state[:size] = x
        if zlib.crc32(out[first:stop].astype("<u4").tobytes()) != crc:
            raise ValueError(f"segment {k} of a block has a wrong checksum")
        if segment is not None:
            return out[first:stop]
    return out
