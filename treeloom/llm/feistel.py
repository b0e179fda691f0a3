"""A keyed permutation of 0 .. n-1: a balanced Feistel network with cycle-walking.

The network permutes 0 .. 4**k - 1 for the least k that covers n; a value that lands at or
above n goes through again until it is below, which takes fewer than four rounds on average
and keeps the map one-to-one. Position and slot are computed from each other, so no table of
the order exists anywhere.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 6


class Permutation:
    def __init__(self, n: int, key: int):
        if n < 0:
            raise ValueError("a permutation needs a size of 0 or more")
        self.n = n
        self.half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
        self.keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, np.int64)]
        self.mask = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, key: int) -> np.ndarray:
        h = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return left << shift | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("a position outside the permutation")
        keys = self.keys[::-1] if back else self.keys
        out = self._once(x, keys, back)
        while len(over := np.flatnonzero(out >= np.uint64(self.n))):
            out[over] = self._once(out[over], keys, back)
        return out.astype(np.int64)

    def slot(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, False)

    def position(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)
