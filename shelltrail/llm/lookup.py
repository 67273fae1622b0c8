"""Places of many integer keys in a fixed set, by open addressing on arrays."""

from __future__ import annotations

import numpy as np


class Lookup:
    """find(keys) is each key's place in `keys` (distinct), or -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys[:-1])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several, the last stays
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        place = self.table[slot]
        open_ = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            there = self.table[slot]
            place[open_] = there
            more = (there >= 0) & (self.keys[there] != keys[open_])
            open_, slot = open_[more], slot[more]
        return place
