"""Shingle sets and min-max signatures of whole texts, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from topicspark.llm.common import SPACE, utf8

#: Words of a shingle, permutations (each gives a minimum and a maximum), values of a band.
WORDS, PERMUTATIONS, BAND_VALUES = 4, 40, 4
#: Bytes hashed at a time.
PIECE = 1 << 20

_rng = np.random.default_rng(20240307)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z hash as a-z
_XOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    size = max(PIECE + 1, n)
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and the n + 1 bounds of each row's words."""
    space = SPACE[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space
    begin = inside[:-1].copy()
    begin[1:] &= space[:-1]
    rows = offsets[1:-1]
    rows = rows[rows < len(data)]
    begin[rows] = inside[rows]  # a row's first byte begins a word
    starts = np.flatnonzero(begin)
    stops = ~inside[1:]
    stops[rows[rows > 0] - 1] = True
    ends = np.flatnonzero(stops & inside[:-1]) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # whole words, about PIECE bytes
        at = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, at + PIECE, side="right")))
        up, down = _powers(int(ends[stop - 1] - at) + 1)
        sums = np.zeros(ends[stop - 1] - at + 1, np.uint64)
        np.cumsum(_BYTE[data[at:ends[stop - 1]]] * up[:len(sums) - 1], out=sums[1:])
        s, e = starts[k:stop] - at, ends[k:stop] - at
        hashes[k:stop] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        k = stop
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row: of ``words`` consecutive
    words, or of all where there are fewer; empty without words."""
    data, offsets = utf8(column)
    hashes, bounds = word_hashes(data, offsets)
    k = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * k + hashes[i:i + len(rolled)]
    rolled = mixed(rolled)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= words:
            yield np.unique(rolled[s:e - words + 1])
        elif e > s:
            h = np.array([e - s], np.uint64)
            for i in range(s, e):
                h = h * k + hashes[i]
            yield mixed(h)
        else:
            yield np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for s in range(0, len(found), 1 << 15):
        x = (found[None, s:s + (1 << 15)] ^ _XOR) * _MUL
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys (rows x bands) of signatures (rows x values): a key for each
    ``BAND_VALUES`` values; minima and maxima of other permutations meet in a band."""
    half = values.shape[1] // 2
    v = np.concatenate([values[:, :half], np.roll(values[:, half:], half // 2, axis=1)], axis=1)
    v = v.reshape(len(v), -1, BAND_VALUES)
    key = np.broadcast_to(np.arange(v.shape[1], dtype=np.uint64), v.shape[:2])
    for i in range(BAND_VALUES):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + v[:, :, i])
    return key


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
