"""Cuckoo filters over 64-bit keys, filled, emptied and asked in whole arrays at once."""

from __future__ import annotations

import numpy as np

from nightframes.llm.buffers import mix

SLOTS = 4
# Share of slots in use beyond which a filter is made anew at twice the size.
LOAD = 0.85
ROUNDS = 500


def prints(keys: np.ndarray) -> np.ndarray:
    """Non-zero 16-bit fingerprints, from other bits than the bucket's."""
    return np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def jump(found: np.ndarray, mask) -> np.ndarray:
    """What turns one bucket of a fingerprint into the other."""
    return (mix(found.astype(np.uint64)) & np.uint64(0x7FFFFFFF)).astype(np.int64) & mask


class CuckooFilter:
    """``table`` has one row of SLOTS fingerprints per bucket; 0 is a free slot."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.int64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(0, int(np.ceil(keys / (SLOTS * LOAD))) - 1).bit_length()
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys, as small as they go into it."""
        size = len(keys)
        while True:
            made = cls.sized(size)
            if made.insert(keys):
                return made
            size = 2 * max(1, size)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def room(self, keys: int) -> bool:
        return np.count_nonzero(self.table) + keys <= LOAD * self.table.size or not keys

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = prints(keys)
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        return found, first, first ^ jump(found, self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found, first, other = self.places(keys)
        return ((self.table[first] == found[:, None]) | (self.table[other] == found[:, None])).any(axis=1)

    def _fill(self, found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put what goes into free slots of the buckets ``at``; the rest comes back, by bucket."""
        order = np.argsort(at, kind="stable")
        found, at = found[order], at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        used = self.table[at] != 0
        fits = rank < SLOTS - used.sum(axis=1)
        slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[at[fits], slot] = found[fits]
        return found[~fits], at[~fits]

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys, also such as are there already. If False, some are lost: make a new filter."""
        found, at, _ = self.places(keys)
        for turn in range(ROUNDS):
            found, at = self._fill(found, at)
            if not len(found):
                return True
            found, at = self._fill(found, at ^ jump(found, self.mask))
            if not len(found):
                return True
            # one fingerprint of each full bucket makes room for one that waits
            lead = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            slot = (found[lead].astype(np.int64) + turn) % SLOTS
            gone = self.table[at[lead], slot].copy()
            self.table[at[lead], slot] = found[lead]
            found[lead], at[lead] = gone, at[lead] ^ jump(gone, self.mask)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, each once."""
        found, first, other = self.places(keys)
        while len(found):
            pair = np.minimum(first, other) * 65536 + found
            _, lead = np.unique(pair, return_index=True)
            f, a, b = found[lead], first[lead], other[lead]
            in_first = (self.table[a] == f[:, None]).any(axis=1)
            bucket = np.where(in_first, a, b)
            hit = self.table[bucket] == f[:, None]
            there = hit.any(axis=1)
            self.table[bucket[there], hit[there].argmax(axis=1)] = 0
            rest = np.ones(len(found), bool)
            rest[lead] = False
            found, first, other = found[rest], first[rest], other[rest]


class FilterBank:
    """The filters of all shards side by side, asked together."""

    def __init__(self, tables: list[np.ndarray]):
        sizes = np.array([len(t) for t in tables], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.masks = sizes - 1
        self.table = np.concatenate(tables) if tables else np.zeros((0, SLOTS), np.uint16)

    def contains(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mask, base = self.masks[shard], self.base[shard]
        found = prints(keys)
        first = (keys & np.uint64(0x7FFFFFFFFFFF)).astype(np.int64) & mask
        other = first ^ jump(found, mask)
        return (
            (self.table[base + first] == found[:, None]) | (self.table[base + other] == found[:, None])
        ).any(axis=1)
