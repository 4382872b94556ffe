"""Names of substrings by prefix doubling, for one text at a time."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(31)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each (a, b): 64 bits, equal where both are."""
    x = a * _A + b * _B
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    return x


def names(raw: np.ndarray, *lengths: int, seed: int = 0x51) -> list[np.ndarray]:
    """For each length, the name of the substring of that many bytes from each position on. Offsets double: 1, 2, 4, ... Names of another seed are others."""
    levels, size = [pair(raw.astype(np.uint64), np.full(len(raw), seed, np.uint64))], 1
    while 2 * size <= max(lengths):
        last = levels[-1]
        levels.append(pair(last[: max(0, len(last) - size)], last[size:]))
        size *= 2
    out = []
    for length in lengths:
        name, done = None, 0
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                piece = levels[k][done:]
                name = piece if name is None else pair(name[: len(piece)], piece[: len(name)])
                done += 1 << k
        out.append(name[: max(0, len(raw) - length + 1)])
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    if len(values) < width:
        return values[:0]
    now, size = values, 1
    while 2 * size <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return np.minimum(now[: len(values) - width + 1], now[width - size :][: len(values) - width + 1])
