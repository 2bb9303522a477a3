"""64-bit hashes of the words of many texts at once, by numpy."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places in a word for which each byte's value is kept in a table; later places are mixed as they come.
PLACES = 64
#: Bytes that are hashed at a time.
SEGMENT = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _MIX)


with np.errstate(over="ignore"):
    _BYTE = stream(256, 11)
    _PLACED = mixed((_BYTE[None, :] + np.arange(PLACES, dtype=np.uint64)[:, None] * _MIX).ravel())


def hashed_words(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that are no ``gap``; the last byte must be one.

    A word's hash is the mixed sum of its bytes' values, each mixed with the
    byte's place first, so that no arithmetic between places makes words equal.
    Bytes are taken ``SEGMENT`` at a time, cut behind a gap, so that what is held
    for each byte is held for a part of a very long text alone.
    """
    parts, at = [], 0
    while True:
        end = min(len(data), at + SEGMENT)
        end += int(np.argmax(gap[end - 1 :])) if end < len(data) else 0
        starts, ends, hashes = _hashed(data[at:end], gap[at:end])
        if at == 0 and end == len(data):
            return starts, ends, hashes
        parts.append((starts + at, ends + at, hashes))
        at = end
        if at == len(data):
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashed(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = turns[0::2], turns[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    with np.errstate(over="ignore"):
        values = _PLACED[np.minimum(place, PLACES - 1) * 256 + data]
        late = np.flatnonzero((place >= PLACES) & ~gap)
        values[late] = mixed(_BYTE[data[late]] + place[late].astype(np.uint64) * _MIX)
        values[gap] = 0
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return starts, ends, mixed(sums[ends] - sums[starts])
