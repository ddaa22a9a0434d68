"""Words of a batch of texts as 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: White space of ASCII: 0x20 and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Rolling:
    """Polynomial hashes modulo 2^64 of stretches of a sequence, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values) + 1:
            n = len(values) + 1
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse)])
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_borders(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes."""
    word = np.r_[False, ~BLANK[raw], False]
    change = np.flatnonzero(word[1:] != word[:-1])
    return change[::2], change[1::2]
