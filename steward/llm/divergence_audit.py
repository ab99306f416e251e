"""Divergence of sources within a language, by an exact recount through perfect hashes.

Terms are runs of letters. Two passes over the corpus:

1. Every task counts, per language, in how many of its documents a term occurs; the sums over all tasks
   filter exactly: terms of LEAST documents or more are kept.
2. Kept terms are dealt to shards by hash. Each shard becomes a minimal perfect hash with its keys stored in
   slot order, one task per shard. The shards are broadcast, and the second pass looks every term up, compares the
   stored key (a stranger may hit a slot) and increments the slot of its (language, source) group in a dense array.

A round broadcasts at most ROUND_BYTES of shards; a larger vocabulary takes more rounds over the corpus, so what is
broadcast doesn't grow with it. A stored key longer than KEY_BYTES is its digest.

Shares are integers per 1,000,000,000, smoothed by SMOOTH occurrences a term. The distance of two sources sums
over all kept terms: a task takes a block of slots and a tile of sources, as a dense matrix in which absent
terms have the group's share of zero; terms absent from both sources of a pair are added by their number.

Defined cases: null text, language and source are empty texts; a group without terms has zero counts; a language
without kept terms has distances of 0 and no term rows; a single source has no pairs; rows repeated in the table
count as often as they occur; an empty table gives an empty result; texts and terms of any length are counted
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steward.llm.common import byte_view, mixed, pieces
from steward.llm.groups import clustered, groups
from steward.llm.perfect_hash import PerfectHash
from steward.llm.shingles import powers_to
from steward.staging import staged

LEAST, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Keys of a shard, bytes of a stored key and of the shards of a round.
SHARD_KEYS, KEY_BYTES, ROUND_BYTES = 1 << 18, 64, 64 << 20
#: Counters a task holds; slots of a block and sources of a tile.
DENSE, BLOCK_SLOTS, TILE_SOURCES = 1 << 22, 2048, 128
#: Text worked on at once.
PIECE = 4 << 20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_random = np.random.default_rng(20240613)
_TABLE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, lower-cased, and the text each belongs to."""
    body, ends = byte_view(column)
    inside = _LETTER[body]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(body)]
    opens[cuts] = inside[cuts]
    starts = np.flatnonzero(opens)
    before = np.concatenate([[0], np.cumsum(inside)])  # letters before each byte
    offsets = np.append(before[starts], before[-1])
    letters = _LOWER[body[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
    return words.dictionary_encode(), np.searchsorted(ends, starts, side="right") - 1


def coded(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    column = batch.column(batch.schema.get_field_index(name)).dictionary_encode()
    return column.indices.to_numpy().astype(np.int64), column.dictionary


def keys_of(lang: pa.Array, term: pa.Array) -> pa.Array:
    """Keys of (language, term) pairs. No term holds the joining byte; one longer than KEY_BYTES is a digest of one byte more."""
    both = pc.binary_join_element_wise(pc.cast(lang, pa.large_string()), pc.cast(term, pa.large_string()), pa.scalar("\0", pa.large_string()))
    long = np.flatnonzero(pc.binary_length(both).to_numpy(zero_copy_only=False) > KEY_BYTES)
    if len(long):
        values = both.to_pylist()
        for i in long.tolist():
            values[i] = hashlib.sha256(values[i].encode()).hexdigest().ljust(KEY_BYTES + 1, "#")
        both = pa.array(values, pa.large_string())
    return both


def key_hashes(keys: pa.Array) -> np.ndarray:
    body, ends = byte_view(keys)
    up, down = powers_to(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_TABLE[body] * up[: len(body)], out=sums[1:])
    return mixed((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % shards


def found_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms by language with the number of documents they occur in."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            terms, owner = terms_of(part.column(part.schema.get_field_index("text")))
            lang, langs = coded(part, "lang")
            size = max(1, len(terms.dictionary))
            codes = np.unique(owner * size + terms.indices.to_numpy())
            pairs, counts = np.unique(lang[codes // size] * size + codes % size, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(pairs // size)), pc.cast(terms.dictionary.take(pa.array(pairs % size)), pa.string()), pa.array(counts, pa.int64())],
                ["lang", "term", "docs"])


class Shard:
    """Keys of a shard in slot order behind their perfect hash; keys equal in hash follow in a list of their own."""

    def __init__(self, number: int, words: bytes, starts: list[int], keys: list[str]):
        self.number = number
        self.hash = PerfectHash(np.frombuffer(words, np.uint64), np.array(starts, np.int64))
        self.keys = pa.array(keys, pa.large_string())
        self.rest = {k: i for i, k in enumerate(keys) if i >= len(self.hash)}

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, hashes: np.ndarray, keys: pa.Array) -> np.ndarray:
        slots = self.hash.slots(hashes)
        there = np.flatnonzero(slots >= 0)
        same = pc.equal(self.keys.take(pa.array(slots[there])), keys.take(pa.array(there))).to_numpy(zero_copy_only=False)
        slots[there[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(slots < 0).tolist():
                slots[i] = self.rest.get(keys[i].as_py(), -1)
        return slots


def shard_rows(shards: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column(0), batch.column(1))
            hashes = key_hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(hashes, shards)), pa.array(hashes.view(np.int64)), pc.cast(keys, pa.string())], ["shard", "h", "key"])

    return dealt


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shard: its perfect hash and its keys in slot order."""
    for rows in groups(batches, ["shard"]):
        hashes = rows["h"].to_numpy().view(np.uint64)
        _, first = np.unique(hashes, return_index=True)
        perfect = PerfectHash.of(hashes[first])
        order = np.empty(len(first), np.int64)
        order[perfect.slots(hashes[first])] = first
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        keys = rows["key"].take(pa.array(np.concatenate([order, rest]))).to_pylist()
        yield pa.RecordBatch.from_pylist(
            [{"shard": rows["shard"][0].as_py(), "words": perfect.words.tobytes(), "starts": perfect.starts.tolist(), "keys": keys, "bytes": sum(len(k) + 48 for k in keys)}],
            pa.schema([("shard", pa.int64()), ("words", pa.binary()), ("starts", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("bytes", pa.int64())]))


class Lookup:
    """The broadcast shards of a round: places of (language, term) pairs in 0 to size - 1, and slots of the whole."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards = shards
        self.held = {r[0]: Shard(*r) for r in rows}
        self.bases, self.size = {}, 0
        for number, shard in self.held.items():
            self.bases[number] = self.size
            self.size += len(shard)
        spans = [np.arange(len(s), dtype=np.int64) + (number << 32) for number, s in self.held.items()]
        self.slots = np.concatenate(spans) if spans else np.zeros(0, np.int64)

    def places(self, keys: pa.Array) -> np.ndarray:
        hashes = key_hashes(keys)
        shard = shard_of(hashes, self.shards)
        out = np.full(len(keys), -1, np.int64)
        for number in np.unique(shard).tolist():
            if number in self.held:
                mine = np.flatnonzero(shard == number)
                slots = self.held[number].slots(hashes[mine], keys.take(pa.array(mine)))
                out[mine] = np.where(slots >= 0, slots + self.bases[number], -1)
        return out


_opened: dict[str, Lookup] = {}


def opened(shared, shards: int) -> Lookup:
    """The round's look-up, opened once per Python worker."""
    if shared.id not in _opened:
        _opened.clear()
        _opened[shared.id] = Lookup(shared.value, shards)
    return _opened[shared.id]


class Shared:
    """A broadcast with a name that tells it from others."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def numbered_terms(shared: Shared, shards: int):
    """Kept terms with their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = opened(shared, shards)
        for batch in batches:
            places = look.places(keys_of(batch.column(0), batch.column(1)))
            there = pa.array(np.flatnonzero(places >= 0))
            slots = pa.array(look.slots[places[places >= 0]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(there), batch.column(1).take(there), slots], ["lang", "term", "slot"])

    return run


def recounted(shared: Shared, shards: int, dense: int):
    """(lang, source, slot, n): occurrences of kept terms, counted in dense slots per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = opened(shared, shards)
        rows = max(1, dense // max(1, look.size))
        number: dict[tuple[str, str], int] = {}
        counts = np.zeros(0, np.int64)

        def sent(names: list[tuple[str, str]], row: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in names], pa.string()).take(name), pa.array([x for _, x in names], pa.string()).take(name), pa.array(look.slots[place]), pa.array(n)],
                ["lang", "source", "slot", "n"])

        def held() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(counts)
            if len(at):
                yield sent(list(number), at // look.size, at % look.size, counts[at])

        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                terms, owner = terms_of(part.column(part.schema.get_field_index("text")))
                lang, langs = coded(part, "lang")
                source, sources = coded(part, "source")
                size = max(1, len(terms.dictionary))
                pairs, pair_of = np.unique(lang[owner] * size + terms.indices.to_numpy(), return_inverse=True)
                place = look.places(keys_of(langs.take(pa.array(pairs // size)), terms.dictionary.take(pa.array(pairs % size))))[pair_of]
                known = place >= 0
                place, owner = place[known], owner[known]
                both, group_of = np.unique(lang[owner] * len(sources) + source[owner], return_inverse=True)
                names = [(langs[int(x) // len(sources)].as_py(), sources[int(x) % len(sources)].as_py()) for x in both]
                if len(names) > rows:  # too many groups for dense rows: sorted pairs instead
                    code, n = np.unique(group_of * look.size + place, return_counts=True)
                    yield sent(names, code // look.size, code % look.size, n)
                    continue
                if len(number.keys() | set(names)) > rows:
                    yield from held()
                    number, counts = {}, np.zeros(0, np.int64)
                row = np.array([number.setdefault(x, len(number)) for x in names], np.int64)
                wide = np.zeros(len(number) * look.size, np.int64)
                wide[: len(counts)] = counts
                counts = wide
                if len(place):
                    counts += np.bincount(row[group_of] * look.size + place, minlength=len(counts))
        yield from held()

    return run


def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and pair of sources: what the block's terms add to the distance of all terms absent."""
    for rows in groups(batches, ["lang", "block", "low", "high"]):
        source = rows["source"].combine_chunks().dictionary_encode()
        who, names = source.indices.to_numpy().astype(np.int64), source.dictionary.to_pylist()
        slot, p = rows["slot"].to_numpy(), rows["p"].to_numpy()
        zero, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        zero[who], tile[who] = rows["zero"].to_numpy(), rows["tile"].to_numpy()
        cell = slot >= 0
        present, at = np.unique(slot[cell], return_inverse=True)
        shares = np.repeat(zero[:, None], len(present), axis=1)
        shares[who[cell], at] = p[cell]
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        lows, highs = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        out = {"lang": [], "source": [], "item": [], "more": [], "far": []}
        for i in lows.tolist():
            far = np.abs(zero[highs] - zero[i])
            more = np.abs(shares[highs] - shares[i]).sum(axis=1) - far * len(present)
            for j, m, f in zip(highs.tolist(), more.tolist(), far.tolist(), strict=True):
                if i == j:
                    continue
                for a, b in ((i, j), (j, i)) if low != high else ((i, j),):
                    for name, value in zip(out, (rows["lang"][0].as_py(), names[a], names[b], m, f), strict=True):
                        out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("more", pa.int64()), ("far", pa.int64())]))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + SCALE * (count + SMOOTH) / (total + SMOOTH * kept), rounded down; 0 without kept terms."""
    top = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", top, (total + SMOOTH * kept).cast("decimal(19,0)"))
    return F.when(kept > 0, 1 + whole).otherwise(F.lit(0).cast("long"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` compares a source with another of its language,
    `term` lists the terms it uses more than its language does, the TOP first."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.select("text", "lang").mapInArrow(found_terms, "lang string, term string, docs long")
    kept = staged(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST).select("lang", "term"), "kept")
    size = kept.count()
    shards = max(1, -(-size // SHARD_KEYS))
    dealt = kept.mapInArrow(shard_rows(shards), "shard long, h long, key string")
    made = staged(clustered(dealt, ["shard"], shards).mapInArrow(built, "shard long, words binary, starts array<long>, keys array<string>, bytes long"), "shards")

    rounds, room = [], 0
    for shard, n in made.select("shard", "bytes").orderBy("shard").collect():  # one small row per SHARD_KEYS terms
        if room < n:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(shard)
        room -= n
    cells, names = [], []
    for chosen in rounds:
        loaded = [tuple(r) for r in made.where(F.col("shard").isin(chosen)).select("shard", "words", "starts", "keys").collect()]
        shared = Shared(spark.sparkContext.broadcast([(s, bytes(w), list(a), list(t)) for s, w, a, t in loaded]))
        cells.append(rows.mapInArrow(recounted(shared, shards, DENSE), "lang string, source string, slot long, n long"))
        names.append(kept.mapInArrow(numbered_terms(shared, shards), "lang string, term string, slot long"))
    none = spark.createDataFrame([], "lang string, source string, slot long, n long, term string")
    cell, name = none.drop("term"), none.select("lang", "term", "slot")
    for c, t in zip(cells, names, strict=True):
        cell, name = cell.unionByName(c), name.unionByName(t)
    cell = staged(cell.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "cells")

    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    used = cell.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    listed = rows.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("total"))
    group = listed.unionByName(used).groupBy("lang", "source").agg(F.sum("total").alias("total")).join(vocabulary, "lang", "left")
    group = group.withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    group = staged(group.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")
    whole = group.groupBy("lang").agg(F.sum("total").alias("all_total"))
    shared_cells = staged(cell.join(group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))), "shares")

    blocks = max(1, -(-size // BLOCK_SLOTS))
    most = group.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, -(-most // TILE_SOURCES))
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).alias("tile")
    partner = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    fields = ("lang", "source", "slot", "p", "zero", "block", "tile")
    filled = shared_cells.withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks))).select(*fields[:-1], tile)
    empty = group.select("lang", "source", F.lit(-1).cast("long").alias("slot"), F.col("zero").alias("p"), "zero",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), tile)
    met = filled.unionByName(empty).select(*fields, partner).select(*fields, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    parts = clustered(met, ["lang", "block", "low", "high"]).mapInArrow(distances, "lang string, source string, item string, more long, far long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"), F.max("far").alias("far")).join(vocabulary, "lang", "left")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("more") + F.col("far") * F.coalesce("kept", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    of_lang = cell.groupBy("slot").agg(F.sum("n").alias("all_n")).join(name, "slot").join(whole, "lang").join(vocabulary, "lang").select(
        "slot", F.col("term").alias("item"), share(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    above = shared_cells.join(of_lang, "slot").where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    ranked = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(ranked)
