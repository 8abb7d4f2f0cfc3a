"""Words as 64-bit hashes in numpy arrays, and hashes of their windows.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, as bytes.split() takes it.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MOST_WORDS = 300_000
_WRAP = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Hashes(dict):
    """Word to hash, kept for words seen before; it starts anew when it's full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed(words: list[bytes], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        m = 1 << (n - 1).bit_length()

        def series(base: int) -> np.ndarray:
            x = np.full(m, base, np.uint64)
            x[0] = 1
            return np.cumprod(x, dtype=np.uint64)

        _powers[which] = series(_MULTIPLIERS[which]), series(pow(_MULTIPLIERS[which], -1, 1 << 64))
    up, down = _powers[which]
    return up[:n], down[:n]


class Prefix:
    """Polynomial hashes of any run of consecutive hashes in constant time each, in one of two ways that have nothing to do with one another."""

    def __init__(self, h: np.ndarray, which: int = 0):
        up, self.down = _powers_to(len(h) + 1, which)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all runs of n, by start."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])
