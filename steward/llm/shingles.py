"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from steward.llm.common import byte_view, mixed

WIDTH = 5
_random = np.random.default_rng(20240607)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[ord("A"): ord("Z") + 1] = _BYTES[ord("a"): ord("z") + 1]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(WIDTH)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _BASE_BACK)):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end (`ends` has n + 1 offsets), and words per text."""
    size = len(body)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    word = ~_BLANK[body]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < size]
    opens[cuts] = word[cuts]
    starts = np.flatnonzero(opens)
    closes = np.zeros(size + 1, bool)
    closes[1:size] = word[:-1] & (~word[1:] | opens[1:])
    closes[size] = word[-1]
    stops = np.flatnonzero(closes)
    up, down = powers_to(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTES[body] * up[:size], out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, ends))
    return hashes, counts


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The set of each text: sorted, without repeats; empty for a text without words."""
    hashes, counts = word_hashes(*byte_view(column))
    n = max(0, len(hashes) - WIDTH + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        sums += hashes[k: k + n] * _PLACES[k]
    sums = mixed(sums)
    out, at = [], 0
    for count in counts.tolist():
        if count >= WIDTH:
            out.append(np.unique(sums[at: at + count - WIDTH + 1]))
        elif count:
            out.append(mixed(np.sum(hashes[at: at + count] * _PLACES[:count], keepdims=True) + np.uint64(WIDTH - count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
