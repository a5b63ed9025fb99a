"""Words and word windows of Arrow text columns, hashed with numpy, whole texts at a time.

A word is a run of bytes other than space and 0x09-0x0D. Nothing here makes a Python object
for a word: a batch's UTF-8 buffer is scanned as an array, in pieces of a few MB, so that the
memory needed beyond the batch stays bounded whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _bytes_table(seed: int) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    table[_SPACE] = 0
    return table


_TABLES = {seed: _bytes_table(seed) for seed in (1, 2)}
_BASES = {1: _U(0x9E3779B97F4A7C15), 2: _U(0xC2B2AE3D27D4EB4F)}
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _power(seed: int, n: int) -> np.ndarray:
    have = _powers.get(seed)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), _BASES[seed])
        steps[0] = 1
        _powers[seed] = have = np.cumprod(steps)
    return have


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


@dataclass
class Words:
    """Words of `n_docs` texts: `first[i]:first[i + 1]` are those of text i."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: dict[int, np.ndarray]
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words within one text."""
        h = self.hashes[seed]
        size = len(h) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(size, np.uint64)
        for j in range(n):
            total += h[j : j + size] * _MULTIPLIERS[j]
        doc_end = np.repeat(self.first[1:], self.counts)[:size]
        at = np.flatnonzero(np.arange(size) + n <= doc_end)
        return at, mix(total[at])


def _scan(data: np.ndarray, bounds: np.ndarray, seeds, lower: bool):
    """Starts, ends and hashes of the words of one piece; bounds: where texts begin in it."""
    word = ~_SPACE[data]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(word))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    hashes = {}
    if len(start):
        tail = data[start[0] :]
        tail = _LOWER[tail] if lower else tail
        place = np.arange(len(tail), dtype=np.int32) - np.repeat((start - start[0]).astype(np.int32), np.diff(np.append(start, len(data))))
    for seed in seeds:
        if len(start):
            h = np.add.reduceat(_TABLES[seed][tail] * _power(seed, int(place.max()) + 1)[place], start - start[0])
            hashes[seed] = mix(h ^ ((end - start).astype(np.uint64) * _U(0xFF51AFD7ED558CCD)))
        else:
            hashes[seed] = np.zeros(0, np.uint64)
    return start, end, hashes


def words(offsets: np.ndarray, data: np.ndarray, seeds=(1,), lower: bool = False) -> Words:
    """All words of the given texts."""
    starts, ends, hashes = [], [], {s: [] for s in seeds}
    begin = 0
    while begin < len(data):
        stop = min(begin + PIECE, len(data))
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            gaps = np.flatnonzero(_SPACE[data[max(begin, stop - 4096) : stop]]) if stop - begin <= PIECE else np.zeros(0, int)
            if len(gaps):
                stop = max(begin, stop - 4096) + int(gaps[-1]) + 1
            else:
                ahead = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
                stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + PIECE, len(data))
        lo, hi = np.searchsorted(offsets, [begin, stop])
        s, e, h = _scan(data[begin:stop], offsets[lo:hi] - begin, seeds, lower)
        starts.append(s + begin)
        ends.append(e + begin)
        for seed in seeds:
            hashes[seed].append(h[seed])
        begin = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    joined = {s: np.concatenate(h) if h else np.zeros(0, np.uint64) for s, h in hashes.items()}
    return Words(np.searchsorted(start, offsets), start, end, joined, data)


def runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, offsets, bytes): whole texts, together about `limit` bytes."""
    offsets, data = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi
