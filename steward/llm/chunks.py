"""Encoding whole texts through a dictionary of their blank-separated chunks.

A blank between two characters that aren't white space always starts a new piece under the splitting
patterns of byte-level vocabularies, so the ids of a text are those of its chunks end to end: the
first chunk as it is, every other one with its blank in front. Texts in which some blank touches
other white space are split at the safe blanks only. Each chunk is encoded once per batch, and kept
for later batches of the same worker in a dictionary of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space under any of the engines' definitions.
SPACE = "\\x09-\\x0d\\x1c-\\x20\u0085   -     　"
_UNSAFE = f"^$|^[{SPACE}]|[{SPACE}]$"
_SAFE_BLANK = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Chunks kept between batches, and the longest one kept.
KEPT_CHUNKS, KEPT_LENGTH = 250_000, 64
#: Words kept by a `ChunkTable`.
KEPT_WORDS = 500_000


class ChunkEncoder:
    """`encode(list of chunks)` gives each chunk's ids as little-endian bytes of `dtype`."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str):
        self.encode, self.dtype, self.kept = encode, np.dtype(dtype), {}

    def _known(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk; new ones are encoded together."""
        found = {c: self.kept.get(c) for c in chunks}
        new = [c for c, blob in found.items() if blob is None]
        found.update(zip(new, self.encode(new), strict=True))
        if len(self.kept) + len(new) > KEPT_CHUNKS:
            self.kept.clear()
        room = KEPT_CHUNKS - len(self.kept)
        self.kept.update((c, found[c]) for c in new[:room] if len(c) <= KEPT_LENGTH)
        return found

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        return next(self.many([column]))

    def many(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The result of `texts` for each column; all their new chunks are encoded together."""
        parts = [Part(c) for c in columns]
        known = self._known([c for p in parts for cs in (p.inner, p.firsts) for c in cs] + [c for p in parts for cs in p.whole for c in cs])
        for part in parts:
            yield part.ids(known, self.dtype)


class Part:
    """One column of texts as chunks."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        lists = pc.split_pattern(column, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        self.starts = starts[:-1] - starts[0]
        self.counts = np.diff(starts)
        words = lists.flatten().dictionary_encode()
        self.index = words.indices.to_numpy()
        unsafe = pc.match_substring_regex(words.dictionary, _UNSAFE).to_numpy(zero_copy_only=False)
        self.bad = np.bitwise_or.reduceat(unsafe[self.index], self.starts) if self.n else np.zeros(0, bool)
        firsts = words.dictionary.take(pa.array(self.index[self.starts])).to_pylist()
        self.firsts = [f for f, b in zip(firsts, self.bad, strict=True) if not b]
        used = np.zeros(len(unsafe), bool)
        rest = np.repeat(~self.bad, self.counts)
        rest[self.starts] = False
        used[self.index[rest]] = True
        chosen = np.flatnonzero(used)
        self.inner = [" " + w for w in words.dictionary.take(pa.array(chosen)).to_pylist()]
        self.place = np.zeros(len(unsafe), np.int64)
        self.place[chosen] = np.arange(len(chosen))
        self.whole = []  # texts in which some blank isn't safe
        for i in np.flatnonzero(self.bad):
            first, *more = _SAFE_BLANK.split(column[int(i)].as_py())
            self.whole.append([first, *(" " + x for x in more)])

    def ids(self, known: dict[str, bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        blobs = [known[c] for c in self.inner]
        # One more entry for each text: its first chunk, or all of it where a blank isn't safe.
        first, whole = iter(self.firsts), iter(self.whole)
        blobs += [b"".join(known[c] for c in next(whole)) if b else known[next(first)] for b in self.bad]
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // dtype.itemsize
        begins = np.cumsum(lengths) - lengths
        entry = self.place[self.index]
        entry[self.starts] = len(self.inner) + np.arange(self.n)
        take = lengths[entry]
        drop = np.repeat(self.bad, self.counts)
        drop[self.starts] = False
        take[drop] = 0
        sizes = np.add.reduceat(take, self.starts) if self.n else np.zeros(0, np.int64)
        return gathered(np.frombuffer(b"".join(blobs), dtype), begins[entry], take), sizes


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of `values` that begin and last as given, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    where = np.repeat((begins - (ends - lengths)).astype(kind), lengths)
    where += np.arange(total, dtype=kind)
    return values[where]


class ChunkTable:
    """The same encoding with the dictionary in arrays: a column's words are looked up in one vectorised
    pass, and only chunks never seen, or not for a while, become text for the library.

    `encode(list of texts)` gives the ids of each text; `opens[id]` says whether the id's bytes begin with a blank. Words go to the library `RUN` at a time,
    as running text, and are told apart by the ids that open with a blank; where the two numbers differ,
    one by one. The dictionary keeps the half of `limit` words used last whenever it outgrows `limit`.
    """

    RUN = 200

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], opens: np.ndarray, dtype: str, limit: int = KEPT_WORDS):
        self.encode, self.opens, self.dtype, self.limit = encode, opens, np.dtype(dtype), limit
        self.words = pa.array([], pa.string())
        self.values, self.sizes, self.used = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.now = 0

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        n = len(column)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        lists = pc.split_pattern(column, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts[:-1] - starts[0]
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        # A chunk begins with a text and at every blank between two characters that aren't white space.
        begins_bare = ~pc.match_substring_regex(words, f"^$|^[{SPACE}]").to_numpy(zero_copy_only=False)[index]
        ends_bare = ~pc.match_substring_regex(words, f"^$|[{SPACE}]$").to_numpy(zero_copy_only=False)[index]
        begins = np.empty(len(index), bool)
        begins[0] = True
        np.logical_and(begins_bare[1:], ends_bare[:-1], out=begins[1:])
        begins[starts] = True
        heads = np.flatnonzero(begins)
        spans = np.diff(heads, append=len(index))
        leads = np.zeros(len(index), bool)
        leads[starts] = True
        odd = (spans > 1) | leads[heads]

        used, at = np.unique(index[heads[~odd]], return_inverse=True)
        places = self._places(words.take(pa.array(used)))
        chunks = self._joined(flat, heads[odd], spans[odd], leads)
        coded = chunks.dictionary_encode()
        blobs = self.encode(coded.dictionary.to_pylist())
        odd_sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        which = np.empty(len(heads), np.int64)
        which[~odd] = places[at]
        which[odd] = len(self.sizes) + coded.indices.to_numpy()
        sizes = np.concatenate((self.sizes, odd_sizes))
        take = sizes[which]
        ids = gathered(np.concatenate((self.values, *blobs)), (np.cumsum(sizes) - sizes)[which], take)
        counts = np.add.reduceat(take, np.searchsorted(heads, starts))
        self._trim()
        return ids, counts

    @staticmethod
    def _joined(flat: pa.Array, heads: np.ndarray, spans: np.ndarray, leads: np.ndarray) -> pa.Array:
        """Chunks of several words, or at the head of a text; the others keep their blank in front."""
        ends = np.cumsum(spans)
        where = np.repeat(heads - (ends - spans), spans) + np.arange(int(ends[-1]) if len(ends) else 0)
        kept = flat.take(pa.array(where))
        bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), kept), " ")
        front = pa.array(np.where(leads[heads], "", " "), pa.string())
        return pc.binary_join_element_wise(front, bodies, "")

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands in the dictionary; new ones are encoded and added."""
        self.now += 1
        found = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(found))
        places = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(places < 0)
        places[new] = len(self.words) + np.arange(len(new))
        self.used[places[places < len(self.used)]] = self.now
        if len(new):
            values, sizes = self._encoded(fresh)
            self.words = pa.concat_arrays([self.words, fresh])
            self.values, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.sizes, sizes))
            # Long words are the first to go: they seldom come again.
            long = pc.greater(pc.utf8_length(fresh), KEPT_LENGTH).to_numpy(zero_copy_only=False)
            self.used = np.concatenate((self.used, np.where(long, 0, self.now)))
        return places

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each with a blank in front, end to end, and their numbers."""
        n = len(words)
        offsets = pa.array(np.append(np.arange(0, n, self.RUN), n), pa.int32())
        runs = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ").to_pylist()
        values, sizes = [], []
        for k, ids in enumerate(self.encode([f" {r}" for r in runs])):
            cuts = np.flatnonzero(self.opens[ids])
            here = words.slice(k * self.RUN, self.RUN)
            if len(cuts) == len(here) and cuts[0] == 0:
                values.append(ids)
                sizes.append(np.diff(cuts, append=len(ids)))
            else:
                alone = self.encode([f" {w}" for w in here.to_pylist()])
                values.extend(alone)
                sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        return np.concatenate(values), np.concatenate(sizes)

    def _trim(self) -> None:
        if len(self.words) <= self.limit:
            return
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        begins = np.cumsum(self.sizes) - self.sizes
        self.values = gathered(self.values, begins[stay], self.sizes[stay])
        self.words, self.sizes, self.used = self.words.take(pa.array(stay)), self.sizes[stay], self.used[stay]
