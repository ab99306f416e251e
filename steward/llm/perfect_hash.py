"""A minimal perfect hash of a set of keys, built and asked in vectors.

Keys are 64-bit hashes. On each level the keys still open fall into a bit array of GAMMA bits a key; a
key alone on its bit is settled there, the others go on to the next level. The slot of a key is the
number of set bits before its own, so n keys get the slots 0 to n - 1. A stranger may get a slot as well:
whoever asks compares the key stored there.
"""

from __future__ import annotations

import numpy as np

from steward.llm.common import mixed

GAMMA, LEVELS = 2, 64
_GOLDEN = 0x9E3779B97F4A7C15


def _bits(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = mixed(hashes + np.uint64((level + 1) * _GOLDEN % (1 << 64)))
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """`bits` holds all levels end to end, `starts` where each begins, `before` the set bits before each word of 64."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words.astype(np.uint64), starts.astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        """The hash of distinct keys."""
        left, levels, starts = hashes, [], [0]
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("equal keys")
            size = -(-GAMMA * len(left) // 64) * 64
            at = _bits(left, len(levels), size)
            alone = np.bincount(at, minlength=size)
            levels.append(np.packbits(alone == 1, bitorder="little").view("<u8"))
            starts.append(starts[-1] + size)
            left = left[alone[at] > 1]
        return cls(np.concatenate(levels) if levels else np.zeros(0, np.uint64), np.array(starts))

    def __len__(self) -> int:
        return int(self.before[-1])

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where a stranger falls through every level."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (start, stop) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            at = _bits(hashes[open_], level, stop - start) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            row = self.words[word]
            hit = (row >> bit & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(row & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.before[word[hit]] + lower[hit]
            open_ = open_[~hit]
        return out
