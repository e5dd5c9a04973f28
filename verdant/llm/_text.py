"""Vectorised text helpers for Arrow batches: words, lines and rolling hashes over whole texts.

A chunk is the concatenated UTF-8 of some whole documents. All positions are bytes of the chunk;
documents never run into each other, as a document's first byte always begins a new word or line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
LONG_RANGE = 512  # bytes: longer ranges are hashed one by one, by blake2b
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most that many bytes of text each (one longer text: alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of the documents, from 0; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, cut at document starts."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (one per byte) within each document."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """The words of a chunk: byte ranges, document numbers and hashes.

    first[d]..first[d + 1] are the words of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.start, self.end = runs(WORD[self.data], offsets)
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = range_hashes(self.data, self.start, self.end)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words that lie within one document."""
        h = self.hashes()
        if len(h) < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(np.repeat(self.first[1:], self.counts)[: len(h) - k + 1] >= np.arange(k, len(h) + 1))
        return at, window_hashes(h, at, k)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and the byte where each begins (and the end)."""
        size = self.end - self.start
        where = np.concatenate([[0], np.cumsum(size + 1)])
        keep = WORD[self.data]
        out = np.full(int(where[-1]), 0x20, np.uint8)
        hole = np.ones(len(out), bool)
        hole[where[1:] - 1] = False
        out[hole] = self.data[keep]
        return out.tobytes(), where


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; equal bytes give equal hashes wherever they stand."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * _GOLD
    live = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
    done = 0
    while len(live):
        h[live] = mix(h[live] ^ (lanes[start[live] + done] & _TAILS[np.minimum(size[live] - done, 8)])) + _GOLD
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_RANGE):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k values that begin at each place: a sum with an odd factor for each position."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    total = np.full(len(at), np.uint64(k), np.uint64)
    for j in range(k):
        total += h[at + j] * factors[j]
    return mix(total)


def set_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sets h[first[i]:first[i + 1]], whatever their order."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _GOLD), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * _GOLD)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values, by doubling."""
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges; what a range has beyond them is ignored."""
    edge = np.bincount(np.minimum(start, n), minlength=n + 1) - np.bincount(np.minimum(end, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def binary(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.binary())
