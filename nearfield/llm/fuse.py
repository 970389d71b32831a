"""Static binary-fuse filters: 8 bits a slot, three slots a key, about 9 bits a key, false positives of 1 in 256.

Built once for a fixed set of 64-bit keys. All steps are NumPy over whole arrays: slots that only one key uses are peeled
in rounds, and the fingerprints are written in the reverse order of the rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

MAX_SEEDS = 100
_U32 = np.uint64(32)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed)
    for _ in range(2):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    slots: np.ndarray

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.segment - 1)
        a = (h >> _U32) * np.uint64(self.segment * self.segments) >> _U32
        b = (a + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        c = (a + np.uint64(2 * self.segment)) ^ (h & mask)
        return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> _U32)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """The filter of a set of keys (uint64; repeated ones count once; none at all is allowed)."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
        factor = 0.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, -(-round(n * factor) // segment) - 2)
        length = (segments + 2) * segment
        for seed in range(1, MAX_SEEDS):
            made = cls(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, np.zeros(length, np.uint8))
            if made._fill(_mix(keys, made.seed)):
                return made
        raise ValueError("no seed gave a peelable filter")

    def _fill(self, h: np.ndarray) -> bool:
        at = np.stack(self._places(h))
        n = len(h)
        number = np.arange(n)
        counts = np.bincount(at.ravel(), minlength=len(self.slots))
        held = np.zeros(len(self.slots), np.int64)
        for row in at:
            np.bitwise_xor.at(held, row, number)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        done, single = 0, np.flatnonzero(counts == 1)
        while len(single):
            key, first = np.unique(held[single], return_index=True)
            slot = single[first]
            rounds.append((key, slot))
            done += len(key)
            touched = at[:, key].ravel()
            np.subtract.at(counts, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[counts[touched] == 1]
        if done < n:
            return False
        prints = self._print(h)
        for key, slot in reversed(rounds):
            self.slots[slot] = 0
            a, b, c = at[:, key]
            self.slots[slot] = prints[key] ^ self.slots[a] ^ self.slots[b] ^ self.slots[c]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for 1 in 256 others."""
        h = _mix(keys, self.seed)
        a, b, c = self._places(h)
        return self._print(h) == self.slots[a] ^ self.slots[b] ^ self.slots[c]
