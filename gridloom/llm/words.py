"""Words of many texts at once, in numpy: where they lie, and 128-bit hashes of them.

A word is a run of bytes other than ASCII white space. Nothing here loops over
words, except for those of more than ``LONG`` bytes, which are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG = 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.asarray([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _mixed2(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)


def byte_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of bytes; ``data`` has at least eight bytes after the last run."""
    lanes = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    low, high = mixed(size.astype(np.uint64)), _mixed2(size.astype(np.uint64))
    live, at, left = slice(None), start, size
    while len(at):
        v = lanes[at] & _MASKS[np.minimum(left, 8)]
        low[live] = mixed(low[live] ^ v)
        high[live] = _mixed2(high[live] + v)
        more = np.flatnonzero((left > 8) & (left <= LONG))
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    big = np.flatnonzero(size > LONG)
    if len(big):
        import xxhash

        for i in big.tolist():
            low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(data[start[i] : start[i] + size[i]]), "<u8")
    return low, high


class Words:
    """Words of consecutive texts in one buffer: ``start`` and ``size`` in bytes, ``first`` word of each text (and the end)."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.offsets, self.n = batch, offsets, len(offsets) - 1
        self.data = np.concatenate([data, np.full(8, 32, np.uint8)])
        solid = ~_SPACE[data]
        some = np.flatnonzero(np.diff(offsets))
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        firsts, lasts = offsets[some], offsets[some + 1] - 1
        begins[firsts], stops[lasts] = solid[firsts], solid[lasts]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(stops) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return byte_hashes(self.data, self.start, self.size)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def joined(self, keep: np.ndarray | None = None) -> Iterator[memoryview]:
        """Each text's words (those of ``keep``) joined by single spaces."""
        start, size, first = self.start, self.size + 1, self.first
        if keep is not None:
            start, size = start[keep], size[keep]
            first = np.concatenate([[0], np.cumsum(keep)])[first]
        ends = np.cumsum(size)
        marks = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
        if len(ends):
            marks[0] = start[0]
            marks[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
        out = self.data[np.cumsum(marks)] if len(ends) else np.zeros(0, np.uint8)
        out[ends - 1] = 32
        view, at = memoryview(out), np.concatenate([[0], ends])[first].tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield view[a : max(a, b - 1)]

    def words(self, which: np.ndarray) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.start[which].tolist(), (self.start + self.size)[which].tolist(), strict=True)]


def word_chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 2 << 20) -> Iterator[Words]:
    """Slices of the batches with about ``max_bytes`` of text each (a longer text comes alone, whole); null is empty."""
    for batch in batches:
        column = batch.column(text).fill_null("").cast(pa.large_binary())
        if not len(column):
            continue
        _, where, held = column.buffers()
        offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        begin = 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1)
            yield Words(batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
            begin = end


# What is taken off a word's ends, and lower case, in ASCII.
_EDGES = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_EDGE = np.zeros(256, bool)
_EDGE[list(_EDGES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normal(word: bytes) -> bytes:
    """Lower case without punctuation at either end; a word of punctuation alone stays."""
    return word.strip(_EDGES).lower() or word


def normal_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words as ``normal`` makes them."""
    start, size = words.start.copy(), words.size.copy()
    for from_end in (False, True):
        live = np.arange(len(start))
        for _ in range(16):
            live = live[_EDGE[words.data[start[live] + (size[live] - 1 if from_end else 0)]] & (size[live] > 0)]
            size[live] -= 1
            start[live] += not from_end
        for i in live.tolist():
            # longer runs of punctuation, one by one
            own = words.data[start[i] : start[i] + size[i]].tobytes()
            kept = own.rstrip(_EDGES) if from_end else own.lstrip(_EDGES)
            start[i] += 0 if from_end else len(own) - len(kept)
            size[i] = len(kept)
    none = size == 0
    start[none], size[none] = words.start[none], words.size[none]
    return byte_hashes(_LOWER[words.data], start, size)


def hashes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words that are given one by one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return byte_hashes(np.frombuffer(b"".join(words) + b" " * 8, np.uint8), np.cumsum(sizes) - sizes, sizes)


class Numbers:
    """Numbers from 1 of given words by their hashes; all other words are 0."""

    def __init__(self, words: list[bytes], bits: int = 18):
        low, high = hashes_of(words)
        self.order = np.argsort(low, kind="stable")
        self.low, self.high, self.shift = low[self.order], high[self.order], np.uint64(64 - bits)
        slots = (self.low >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(slots, np.arange(1 << bits)).astype(np.int32)
        self.depth = int(np.bincount(slots).max(initial=0))
        self.filled = np.zeros(1 << bits, bool)
        self.filled[slots] = True

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, slot = np.zeros(len(low), np.int32), (low >> self.shift).astype(np.int64)
        live = np.flatnonzero(self.filled[slot])
        at = self.begin[slot[live]]
        for j in range(self.depth):
            place = np.minimum(at + j, len(self.low) - 1)
            hit = (self.low[place] == low[live]) & (self.high[place] == high[live])
            out[live[hit]] = self.order[place[hit]] + 1
        return out
