"""A cuckoo filter on numpy: many keys are looked up, added or taken out per call."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200


class Cuckoo:
    """A multiset of fingerprints in buckets of four; keys are rows of two uint64 (a 128-bit hash).

    A key's fingerprint may lie in two buckets, each computable from the other and the fingerprint. The buckets' numbers
    have ``base`` bits of the key's hash and then bits of the fingerprint itself, one more each time the table doubles, so
    the filter grows without the keys. What finds no place (more than eight equal fingerprints) goes to ``stash``. There
    are no false negatives as long as only keys are taken out that were added."""

    def __init__(self, bits: int = 32, base: int = 10):
        self.bits, self.base = bits, base
        self.table = np.zeros((1 << base, SLOTS), dtype=np.uint32)
        self.stash = np.zeros(0, dtype=np.uint64)

    @classmethod
    def load(cls, blob: bytes, bits: int = 32, base: int = 10) -> Cuckoo:
        made = cls(bits, base)
        if blob:
            buckets, waiting = (int(x) for x in np.frombuffer(blob[:16], dtype=np.uint64))
            cut = len(blob) - 8 * waiting
            made.table = np.frombuffer(blob[16:cut], dtype=np.uint32).reshape(buckets, SLOTS).copy()
            made.stash = np.frombuffer(blob[cut:], dtype=np.uint64).copy()
        return made

    def dump(self) -> bytes:
        head = np.array([len(self.table), len(self.stash)], dtype=np.uint64)
        return head.tobytes() + self.table.tobytes() + self.stash.tobytes()

    @property
    def _doubled(self) -> int:
        return len(self.table).bit_length() - 1 - self.base

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & np.uint64((1 << self.base) - 1)
        return at ^ (step | np.uint64(1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = keys[:, 1] % np.uint64((1 << self.bits) - 1) + np.uint64(1)
        high = (mark & np.uint64((1 << self._doubled) - 1)) << np.uint64(self.base)
        return mark, keys[:, 0] & np.uint64((1 << self.base) - 1) | high

    def _waiting(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """A stashed fingerprint with the lower of its two places before any doubling."""
        low = np.uint64((1 << self.base) - 1)
        return np.minimum(at & low, self._other(at, mark) & low) << np.uint64(32) | mark

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        narrow = mark.astype(np.uint32)[:, None]
        hit = (self.table[at] == narrow).any(axis=1) | (self.table[self._other(at, mark)] == narrow).any(axis=1)
        return hit | np.isin(self._waiting(at, mark), self.stash) if len(self.stash) else hit

    def _fill(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put what fits into the buckets ``at``; returns which did not."""
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        nth = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
        free = self.table[ranked] == 0
        fits = nth < free.sum(axis=1)
        slot = ((np.cumsum(free, axis=1) == (nth + 1)[:, None]) & free).argmax(axis=1)
        self.table[ranked[fits], slot[fits]] = mark[order][fits]
        return np.sort(order[~fits])

    def _double(self) -> None:
        moves = (self.table >> np.uint32(self._doubled)) & np.uint32(1) == 1
        self.table = np.concatenate([np.where(moves, 0, self.table), np.where(moves, self.table, 0)]).astype(np.uint32)

    def insert(self, keys: np.ndarray) -> None:
        mark, at = self._places(keys)
        held = int(np.count_nonzero(self.table))
        kicks = 0
        while len(mark):
            room = (held + len(mark)) <= 0.9 * self.table.size
            if (not room or kicks >= KICKS) and self._doubled < self.bits and held + len(mark) > 0.4 * self.table.size:
                bit = np.uint64(self._doubled)
                at = at | (mark >> bit & np.uint64(1)) << (np.uint64(self.base) + bit)
                self._double()
                kicks = 0
                continue
            if kicks >= KICKS:
                self.stash = np.sort(np.concatenate([self.stash, self._waiting(at, mark)]))
                return
            for _ in range(2):
                left = self._fill(at, mark)
                held += len(at) - len(left)
                at, mark = at[left], mark[left]
                at = self._other(at, mark)
            # both buckets full: one newcomer per bucket takes the place of another fingerprint
            bucket, first = np.unique(at, return_index=True)
            slot = (bucket + np.uint64(kicks)) % np.uint64(SLOTS)
            out = self.table[bucket, slot].astype(np.uint64)
            self.table[bucket, slot] = mark[first]
            mark[first], at[first] = out, self._other(bucket, out)
            kicks += 1

    def remove(self, keys: np.ndarray) -> None:
        """Take out one fingerprint per key."""
        mark, at = self._places(keys)
        while len(mark):
            name = self._waiting(at, mark)
            _, now = np.unique(name, return_index=True)  # equal fingerprints go one after the other
            m, a = mark[now], at[now]
            missing = np.ones(len(m), dtype=bool)
            for place in (a, self._other(a, m)):
                same = self.table[place] == m.astype(np.uint32)[:, None]
                found = missing & same.any(axis=1)
                self.table[place[found], same.argmax(axis=1)[found]] = 0
                missing &= ~found
            for one in name[now][missing]:
                spot = np.searchsorted(self.stash, one)
                if spot < len(self.stash) and self.stash[spot] == one:
                    self.stash = np.delete(self.stash, spot)
            keep = np.ones(len(mark), dtype=bool)
            keep[now] = False
            mark, at = mark[keep], at[keep]
