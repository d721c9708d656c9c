"""Words of many texts at a time: places, lengths and 64-bit hashes, computed on the bytes of an Arrow array."""

from __future__ import annotations

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_VALUE = np.random.default_rng(20240607).integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_VALUE[IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashed(data: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and hashes of the words at these starts: to the next start, without what is not solid after them."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spans = np.diff(starts, append=len(data))
    where = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
    power = np.full(int(spans.max()), _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    value = _VALUE[data[starts[0] :]]
    value *= power.take(where)
    at = starts - starts[0]
    lengths = np.add.reduceat(solid[starts[0] :].astype(np.int32), at).astype(np.int64)
    return lengths, mix(np.add.reduceat(value, at) ^ lengths.astype(np.uint64))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word begins at each byte, and whether the byte is in one; words end at documents' ends."""
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inside = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inside] = ~space[inside]
    return first, ~space


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: starts and hashes, and the offsets of documents in them."""
    first, solid = word_starts(data, offsets)
    starts = np.flatnonzero(first)
    return starts, hashed(data, starts, solid)[1], np.searchsorted(starts, offsets)
