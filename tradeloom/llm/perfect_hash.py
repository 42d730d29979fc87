"""A minimal perfect hash in numpy: every key has a slot of its own from 0 on, in about three bits a key.

Keys go to a table of twice as many bits by a hash; those that are alone at their place set its bit, the others go to the next table. A key's
slot is the rank of its bit over all tables. A key that wasn't built in may get a slot, too, so users compare with the key that is stored there.
"""

from __future__ import annotations

import numpy as np

from tradeloom.llm.rolling import MIX_MORE, mixed

#: Bits a key of a table.
ROOM = 2


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """``keys``: distinct 64-bit numbers."""
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []  # bits, words of 64 of them, rank before each word
        placed = 0
        while len(keys):
            size = -(-ROOM * len(keys) // 64) * 64
            at = self._at(keys, len(self.tables), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = placed + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.tables.append((size, words, ranks[:-1]))
            placed = int(ranks[-1])
            keys = keys[~alone[at]]
        self.size = placed

    @staticmethod
    def _at(keys: np.ndarray, table: int, size: int) -> np.ndarray:
        salt = np.uint64((table + 1) * MIX_MORE & 0xFFFFFFFFFFFFFFFF)
        return (mixed(keys + salt) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that weren't built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for table, (size, words, ranks) in enumerate(self.tables):
            if not len(left):
                break
            at = self._at(keys[left], table, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = ranks[at[hit] >> 6] + below
            left = left[~hit]
        return out
