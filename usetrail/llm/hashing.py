"""Vectorised 64-bit hashes of bytes, words and runs of them (numpy, modulo 2**64)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RANDOM = np.random.default_rng(20_240_501)
#: A random value per byte, so that similar bytes do not hash alike.
BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the next power of two."""
    return _powers(1 << max(12, (n - 1).bit_length()), int(base))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole value (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash: out[e] and out[s] give the hash of values[s:e]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:]) if len(values) else None
    return out


def segments(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal for equal runs wherever they stand."""
    return mix((running[end] - running[start]) * powers(len(running), UNBASE)[start])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each word starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word of a text."""
    raw, start, end = word_bounds(data)
    return segments(prefix(BYTE[raw]), start, end)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values; empty if there are fewer."""
    m = len(values) - n + 1
    if m <= 0:
        return values[:0]
    out = values[:m] * powers(n)[0]
    for i in range(1, n):
        out = out + values[i : i + m] * powers(n)[i]
    return mix(out)
