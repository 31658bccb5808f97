"""Minimal perfect hashing of 64-bit keys: each of n distinct keys gets its own slot below n.

Keys are thrown into a bit array of about twice their number; those alone at their place
stay there and the rest go on to the next, smaller array. A key's slot is the number of set
bits before its own. Two bits per key and level, about 3.7 bits a key altogether.
"""

from __future__ import annotations

import numpy as np

from nightframes.llm.buffers import mix

GAMMA = 2.0


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) - bits + before
            before += int(bits.sum())
            self.ranks.append(rank)
        self.size = before

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct unsigned 64-bit integers."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; a key that was not built in gets any slot or -1."""
        keys = np.asarray(keys, np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = self.place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        levels, at = [], 8 * (n + 1)
        for size in sizes:
            step = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(levels)
