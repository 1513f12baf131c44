"""A table from hashed chunks of bytes to lists of ids, filled and asked for whole arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import word_hashes


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class ChunkTable:
    """Ids of chunks by their 64-bit hash; open addressing, emptied when it holds ``limit`` chunks or 16 times as many ids.

    ``learn`` gives the ids of chunks seen for the first time: an array of ids one after the
    other, and how many each chunk has (-1: the chunk has no ids of its own).
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 2_000_000):
        self.learn, self.limit = learn, limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.starts, self.lengths, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), 1
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed chunk, 0 if unknown; open addressing with linear probes."""
        at, mask = h & np.uint64(len(self.keys) - 1), np.uint64(len(self.keys) - 1)
        key = self.keys[at]
        out = np.where(key == h, self.slots[at], 0)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & mask
            key = self.keys[at[todo]]
            out[todo] = np.where(key == h[todo], self.slots[at[todo]], 0)
            todo = todo[(key != h[todo]) & (key != 0)]
        return out

    def put(self, h: np.ndarray, slots: np.ndarray) -> None:
        """Enter distinct unknown hashes."""
        if 5 * (self.count + len(h)) > 3 * len(self.keys):
            old = np.flatnonzero(self.keys)
            h, slots = np.r_[self.keys[old], h], np.r_[self.slots[old], slots]
            size = 1 << int(2 * len(h)).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        at = h & mask
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]], self.slots[at[free]] = h[free], slots[free]
            lost = self.keys[at] != h
            h, slots, at = h[lost], slots[lost], (at[lost] + np.uint64(1)) & mask

    def enter(self, h: np.ndarray, texts: list[str]) -> None:
        ids, lengths = self.learn(texts)
        n, total = self.count + len(texts), self.used + len(ids)
        while n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        own = np.maximum(lengths, 0).astype(np.int64)
        self.starts[self.count : n] = self.used + np.cumsum(own) - own
        self.lengths[self.count : n] = lengths
        self.pool[self.used : total] = ids
        self.put(h, np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, total

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has (-1 as learned)."""
        h = np.maximum(word_hashes(data, starts, ends), np.uint64(1))
        k = self.find(h)
        if (new := np.flatnonzero(k == 0)).size:
            fresh, at = np.unique(h[new], return_index=True)
            if self.count + len(fresh) > self.limit or self.used > 16 * self.limit:
                self.forget()
                fresh, at = np.unique(h, return_index=True)
                new = np.arange(len(h))
            raw = data.tobytes()
            at = new[at]
            self.enter(fresh, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            k = self.find(h)
        lengths = self.lengths[k].astype(np.int64)
        return self.pool[ragged(self.starts[k], np.maximum(lengths, 0))], lengths
