"""Byte-level BPE by corpus-level merge replay.

All new pieces of a task's batch are laid end to end as byte tokens. An inverted index maps each
token pair, by the rank of its merge, to the positions where it stands; ranks are replayed from the
lowest up, each merge being applied at all its positions at once, and only the two neighbours of a
merged pair get new index entries. When a merge makes a pair of the same or a lower rank in its
word, the rest of that word waits for it, so every word gets exactly the merges that encoding it
alone would give (lowest rank first, leftmost first). A piece that is a token itself stays whole.

The corpus of a replay is a batch, and a dictionary of bounded size carries results on between the
batches of a worker: a dictionary of all words would have to be joined back to each occurrence, a
shuffle of several times the input, to save a few seconds per task. So encoding is a narrow pass; a
lost executor costs its own tasks.

Defined cases: a null text is empty and has no ids; a very long text, or piece, takes time in
proportion to its length times its logarithm; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.chunks import ChunkEncoder, gathered
from steward.llm.common import blocks, byte_view, pieces, texts_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pair ranks kept for words encoded by themselves.
KEPT_PAIRS = 200_000
#: Bytes of text whose new pieces are one replay, and of those whose words are looked up at once. A worker's memory grows
#: with the first by some twenty times, and it shares an executor with other workers and the heap.
BLOCK_BYTES, PIECE_BYTES = 2 << 20, 1 << 20
_encoders: dict[tuple[str, str], ChunkEncoder] = {}
_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Replay:
    """Merges of one rank table, applied to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.byte, np.int32)
        self.pairs: dict[int, int] = {}  # by left << 32 | right
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int32)
        self.start = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of token pairs, or -1; a token of -1 merges with nothing."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def rank(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, or -1."""
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return found

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word; words aren't empty."""
        return [np.frombuffer(w, "<u4").tolist() for w in self.packed(words)]

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word as little-endian unsigned 32-bit integers; words aren't empty."""
        if not words:
            return []
        size = sum(map(len, words))
        kind = np.int32 if size < (1 << 31) - 2 else np.int64  # of places
        raw = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.repeat(np.arange(len(words), dtype=kind), np.diff(stops, prepend=0))
        # A last place beyond all words: nothing merges with it.
        tokens = np.append(self.byte_ids[raw], np.int32(-1))
        after, before = np.arange(1, size + 2, dtype=kind), np.arange(-1, size, dtype=kind)
        after[stops - 1] = size
        before[np.append(0, stops[:-1])] = size
        merge = np.full(size + 1, -1, np.int32)
        merge[: size - 1] = self.start[raw[:-1], raw[1:]]
        merge[stops - 1] = -1
        places = np.flatnonzero(merge >= 0).astype(kind)
        places = places[np.argsort(merge[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(merge[places], prepend=-1))
        index: dict[int, list[np.ndarray]] = {
            int(merge[run[0]]): [run] for run in np.split(places, cuts[1:]) if len(run)}
        heap = list(index)
        heapq.heapify(heap)
        odd = np.zeros(len(words), bool)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[merge[p] == r]
            if not len(p):
                continue
            q = after[p]
            if len(p) > 1 and (q[:-1] == p[1:]).any():  # places that share a token: leftmost first
                free, keep = -1, np.ones(len(p), bool)
                for i, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    keep[i] = a >= free
                    if keep[i]:
                        free = b + 1
                p, q = p[keep], q[keep]
            n = after[q]
            tokens[p], tokens[q] = r, -1
            merge[p] = merge[q] = -1
            after[p] = n
            before[n] = p
            left = before[p]
            new = np.concatenate([p, left])
            ranks = self.ranks_of(np.concatenate([tokens[p], tokens[left]]), np.concatenate([tokens[n], tokens[p]]))
            merge[new] = ranks
            merge[size] = -1
            found = ranks >= 0
            if found.any():
                new, ranks = new[found], ranks[found]
                if (ranks <= r).any() and len(p) > 1:
                    # Such a merge must come before the word's other places of this rank: words that
                    # had several are encoded by themselves.
                    words_of, times = np.unique(owner[p], return_counts=True)
                    odd[np.intersect1d(words_of[times > 1], owner[new[ranks <= r]])] = True
                if len(new) > 1:
                    order = np.argsort(ranks, kind="stable")
                    new, ranks = new[order], ranks[order]
                    runs = np.split(new, np.flatnonzero(np.diff(ranks)) + 1)
                else:
                    runs = [new]
                at = 0
                for run in runs:
                    rank = int(ranks[at])
                    at += len(run)
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(run)
        live = tokens[:size] >= 0
        counts = np.add.reduceat(live, np.append(0, stops[:-1]))
        flat = tokens[:size][live].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        out = [flat[e - 4 * c: e] for e, c in zip(ends, counts.tolist(), strict=True)]
        again = np.flatnonzero(odd).tolist()
        for i, ids in zip(again, self.one_by_one([words[i] for i in again]), strict=True):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def one_by_one(self, words: list[bytes]) -> list[list[int]]:
        """The same merges, place by place; the rest of a word waits for merges of lower rank."""
        if not words:
            return []
        known, rank, byte = self.pairs.get, self.rank, self.byte
        data = b"".join(words)
        size = len(data)
        tokens = [byte[b] for b in data]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        stops, at = [], 0
        for w in words:
            before[at] = -1
            at += len(w)
            after[at - 1] = size  # no token follows
            stops.append(at)
        stop_of = np.repeat(np.array(stops, np.int64), np.diff(np.array([0, *stops], np.int64))).tolist()
        raw = np.frombuffer(data, np.uint8)
        first = np.full(size, -1, np.int32)
        first[:-1] = self.start[raw[:-1], raw[1:]]
        first[np.array(stops, np.int64) - 1] = -1
        merge = first.tolist()  # rank of the merge that a position would begin
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[places], prepend=-1))
        index: dict[int, list[int]] = {
            int(first[run[0]]): run.tolist() for run in np.split(places, cuts[1:]) if len(run)}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            places.sort()
            waits = -1  # positions before this one wait for a merge of the same or a lower rank
            for p in places:
                if merge[p] != r:
                    continue
                if p < waits:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(p)
                    continue
                q = after[p]
                n, left = after[q], before[p]
                tokens[p], tokens[q], merge[q], after[p], merge[p] = r, -1, -1, n, -1
                if n < size:
                    before[n] = p
                    b = tokens[n]
                    new = known(r << 32 | b)
                    if new is None:
                        new = rank(r, b)
                    if new >= 0:
                        merge[p] = new
                        if new <= r:
                            waits = stop_of[p]
                        if new not in index:
                            index[new] = []
                            heapq.heappush(heap, new)
                        index[new].append(p)
                if left >= 0:
                    a = tokens[left]
                    new = known(a << 32 | r)
                    if new is None:
                        new = rank(a, r)
                    merge[left] = new
                    if new >= 0:
                        if new <= r:
                            waits = stop_of[p]
                        if new not in index:
                            index[new] = []
                            heapq.heappush(heap, new)
                        index[new].append(left)
        out, at = [], 0
        for w in words:
            out.append([t for t in tokens[at: at + len(w)] if t >= 0])
            at += len(w)
        return out


def replay_encoder(path: str, pattern: str) -> ChunkEncoder:
    """Chunks by merge replay; one encoder per worker process, rank file and pattern."""
    if (path, pattern) in _encoders:
        return _encoders[path, pattern]
    replay, split = Replay(read_ranks(path)), regex.compile(pattern)

    def encode(chunks: list[str]) -> list[bytes]:
        parts = [split.findall(c) for c in chunks]
        known = dict.fromkeys((p for ps in parts for p in ps), b"")
        merged, raw = [], []
        for p in known:
            b = p.encode()
            whole = replay.ranks.get(b)
            if whole is not None:
                known[p] = whole.to_bytes(4, "little")
            else:
                merged.append(p)
                raw.append(b)
        known.update(zip(merged, replay.packed(raw), strict=True))
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in parts]

    _encoders[path, pattern] = ChunkEncoder(encode, "<u4")
    return _encoders[path, pattern]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = replay_encoder(path, pattern)
    for block in blocks(batches, "text", PIECE_BYTES, BLOCK_BYTES):
        for piece, (ids, sizes) in zip(block, encoder.many([texts_of(p, "text") for p in block]), strict=True):
            offsets = np.append(0, np.cumsum(sizes * 4))
            column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([piece.column(0), column.cast(pa.binary())], ["carried", "ids"])


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _tables:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        _tables[path] = (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths)
    data, begins, lengths = _tables[path]
    for batch in batches:
        for piece in pieces(batch, "ids", 2 << 20):
            body, ends = byte_view(piece.column(1))
            ids = np.frombuffer(body.tobytes(), "<u4")
            sizes = lengths[ids]
            offsets = np.append(0, np.cumsum(sizes))[ends // 4]
            text = gathered(data, begins[ids], sizes)
            column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([*piece.columns, column.cast(pa.binary())], ["carried", "ids", "decoded"])


def _carried(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` as a struct of its other columns and the text, and the struct's type."""
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("carried")
    rows = docs.select(carried, "text")
    return rows, rows.schema["carried"].dataType.simpleString()


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """carried (the other columns) and ids: little-endian unsigned 32-bit integers."""
    rows, kind = _carried(docs)
    return rows.mapInArrow(lambda batches: encoded_batches(batches, ranks, pattern), f"carried {kind}, ids binary")


def decoded(rows: DataFrame, ranks: str) -> DataFrame:
    """`rows` of `encoded` with `decoded`, the bytes of the ids."""
    kind = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: decoded_batches(batches, ranks), f"carried {kind}, ids binary, decoded binary")


def encoded_and_decoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The result of `decoded(encoded(...))` in one pass through one worker."""
    rows, kind = _carried(docs)
    return rows.mapInArrow(lambda batches: decoded_batches(encoded_batches(batches, ranks, pattern), ranks),
                           f"carried {kind}, ids binary, decoded binary")


def tokens(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids, and digests of the ids and of the bytes they decode to."""
    both = encoded_and_decoded(docs.select("doc_id", "text"), ranks, pattern)
    return both.select(
        F.col("carried.doc_id").alias("doc_id"), "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
