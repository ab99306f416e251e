"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is LENGTH consecutive words of one text. Its minimiser is the least of its GRAM-word grams, by hash;
the leftmost of equal ones. Equal windows have equal minimisers, and consecutive windows of a text that share one are a
super-k-mer: one string of words. So windows meet without being written out one by one:

1. Minimisers are counted. A super-k-mer whose minimiser occurs once in the corpus has no repeated window
   and stays where it is.
2. The others travel, each as one packed string, to the bucket of their minimiser. The windows of a bucket's
   strings are sorted, by the words themselves (numbered within the bucket, pairs of numbers numbered again), and
   counted exactly. Windows that occur more than once go back as runs of places.
3. Words under such a run are removed.

Hot minimisers. Strings equal within a task travel once. A minimiser of many occurrences (a line on a third of all
pages) would still make one large bucket, so its super-k-mers are dealt window by window, each to the bucket
of the whole window: different windows part, equal ones meet as one row per task and are judged as they stream by.
The list of such minimisers has at most HOT_KEYS entries, whatever the size of the corpus.

Copies. Texts with equal digests have all their windows repeated; one of them speaks for all.

Defined cases: a null text has no words; texts under LENGTH words never change; every row is a document of its own,
so repeated rows and rows without id repeat each other's windows; within a text windows count as well; an empty table
gives an empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.common import byte_view, mixed, pieces, tasks_for
from steward.llm.shingles import powers_to
from steward.staging import staged

LENGTH, GRAM = 35, 8
WIDTH = LENGTH - GRAM + 1  # grams in a window
#: Occurrences from which a minimiser's bucket is split, and the most such minimisers.
HOT, HOT_KEYS = 4096, 1_000_000
#: Text worked on at once, rows and bytes that a task holds before it sends them, bytes of strings sorted at once.
PIECE, HELD_ROWS, HELD_BYTES, SORTED_BYTES = 1 << 20, 1 << 19, 24 << 20, 4 << 20
TEXT_BYTES = 24 << 20
#: A place is a first word, a number of windows and 12 bits of the text's digest, which part texts whose row keys are equal.
WINDOW_BITS, MARK_BITS = 6, 12
COPY = -1
_random = np.random.default_rng(20240619)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACES = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(LENGTH)], np.uint64)
MEMBERS = "key long, row long, place long, told boolean, times long"
STRINGS = "key long, words binary, single boolean, times long, row long, place long"
_NONE = np.zeros(0, np.int64)


class Words:
    """The words of texts, one blank after each: bytes, n + 1 offsets, and the texts' first words."""

    def __init__(self, column: pa.Array):
        body, ends = byte_view(column)
        inside = ~_BLANK[body]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = ends[1:-1]
        cuts = cuts[cuts < len(body)]
        opens[cuts] = inside[cuts]
        starts = np.flatnonzero(opens)
        letters = np.flatnonzero(inside)
        at = np.arange(len(letters)) + np.searchsorted(starts, letters, side="right") - 1
        self.bytes = np.full(len(letters) + len(starts), 32, np.uint8)
        self.bytes[at] = body[letters]
        firsts = at[np.searchsorted(letters, starts)] if len(starts) else _NONE
        self.offsets = np.append(firsts, len(self.bytes))
        self.heads = np.searchsorted(starts, ends)

    def hashes(self) -> np.ndarray:
        up, down = powers_to(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTES[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        first = self.offsets[:-1]
        return mixed((sums[self.offsets[1:]] - sums[first]) * down[first])

    def string(self, first: int, words: int) -> bytes:
        return self.bytes[self.offsets[first]: self.offsets[first + words] - 1].tobytes()


def runs_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k: k + n] * _PLACES[k]
    return mixed(total)


def least_place(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` neighbours, the leftmost of equal ones."""
    at = np.arange(len(x))
    k = 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while 2 * k <= width:
        at = better(at[:-k], at[k:])
        k *= 2
    rest = width - k
    return better(at[:-rest], at[rest:]) if rest else at


class SuperKmers:
    """The super-k-mers of texts: owner, first word (of all), number of windows, minimiser."""

    def __init__(self, words: Words):
        grams = runs_hash(words.hashes(), GRAM)
        n = len(grams) - WIDTH + 1
        self.owner = self.first = self.count = _NONE
        self.key = _NONE
        if n <= 0:
            return
        least = least_place(grams, WIDTH)
        edge = np.zeros(len(grams) + LENGTH + 1, np.int32)
        long = np.diff(words.heads) >= LENGTH
        np.add.at(edge, words.heads[:-1][long], 1)
        np.add.at(edge, words.heads[1:][long] - LENGTH + 1, -1)
        window = np.cumsum(edge)[:n] > 0
        opens = window.copy()
        opens[1:] &= (least[1:] != least[:-1]) | ~window[:-1]
        starts = words.heads[:-1][long]
        opens[starts] = True
        ends = window & np.append(~window[1:] | opens[1:], True)
        self.first = np.flatnonzero(opens)
        self.count = np.flatnonzero(ends) - self.first + 1
        self.owner = np.searchsorted(words.heads, self.first, side="right") - 1
        self.key = grams[least[self.first]].view(np.int64)


def packed(first: np.ndarray, count: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (first << WINDOW_BITS | count) << MARK_BITS | mark


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> WINDOW_BITS + MARK_BITS, place >> MARK_BITS & (1 << WINDOW_BITS) - 1, place & (1 << MARK_BITS) - 1


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch[name].to_numpy() if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def scattered(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed((row ^ place).view(np.uint64)).view(np.int64)


def found_minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by minimiser. Of those a task holds at once the first asks for all and knows their number; the others,
    if any, are known to be repeated (`told`) and don't go to its task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        key, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, row, place = key[order], row[order], place[order]
        head = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(head)
        times = np.zeros(len(key), np.int64)
        times[starts] = np.diff(np.append(starts, len(key)))
        key = np.where(head, key, scattered(row, place))
        for a in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[a: a + (1 << 17)]) for c in (key, row, place, ~head, times)], ["key", "row", "place", "told", "times"])

    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            words = Words(part.column(part.schema.get_field_index("text")))
            s = SuperKmers(words)
            row, mark = column(part, "row")[s.owner], column(part, "mark")[s.owner]
            held.append((s.key, row, packed(s.first - words.heads[s.owner], s.count, mark)))
            size += len(s.key)
            if size >= HELD_ROWS:
                yield from sent()
                held, size = [], 0
    if size:
        yield from sent()


def repeated_minimisers(hot: int):
    """Of rows sorted by key: places whose minimiser is repeated; keys of `hot` occurrences with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the last key with its rows so far: key, times, row and place if it may be alone

        def out(row, place, key, times) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, place, key, times)], ["row", "place", "hot", "times"])

        def ended() -> Iterator[pa.RecordBatch]:
            if last is not None and last[1] >= hot:
                yield out([None], [None], [last[0]], [last[1]])

        for batch in batches:
            told = column(batch, "told")
            row, place = column(batch, "row"), column(batch, "place")
            if told.any():
                yield out(row[told], place[told], np.full(told.sum(), None), np.full(told.sum(), None))
            key, row, place, times = (column(batch, c)[~told] for c in ("key", "row", "place", "times"))
            if not len(key):
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            total = np.add.reduceat(times, starts)
            same = last is not None and last[0] == key[0]
            if same:
                if last[2] is not None:
                    yield out([last[2]], [last[3]], [None], [None])
                total[0] += last[1]
            else:
                yield from ended()
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            again = total[of] > 1
            full = np.flatnonzero(total[:-1] >= hot)
            if len(full):
                yield out(np.full(len(full), None), np.full(len(full), None), key[starts[full]], total[full])
            yield out(row[again], place[again], np.full(again.sum(), None), np.full(again.sum(), None))
            alone = total[-1] == 1
            last = (key[-1], int(total[-1]), row[-1] if alone else None, place[-1] if alone else None)
        yield from ended()

    return run


def strings_of(hot: object):
    """Packed strings of the listed super-k-mers. Equal ones of a task travel once, then as known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = hot.value
        held: dict[tuple[bytes, bool], list] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for (words, single), (key, times, row, place) in held.items():
                rows.append((key, words, single, times, row, place))
                if len(rows) == 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def known(row: list[int], place: list[int]) -> pa.RecordBatch:
            row, place = np.array(row, np.int64), np.array(place, np.int64)
            none = pa.nulls(len(row), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(scattered(row, place)), none, pa.array(np.zeros(len(row), bool)), pa.array(np.full(len(row), 2)), pa.array(row), pa.array(place)], names)

        names = [x.split()[0] for x in STRINGS.split(", ")]
        types = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                words = Words(part.column(part.schema.get_field_index("text")))
                places = part.column(part.schema.get_field_index("places"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                first, count, mark = unpacked(places.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                mine = (mark == column(part, "mark")[owner]) & (count > 0)
                owner, first, count = owner[mine], first[mine] + words.heads[owner[mine]], count[mine]
                if not len(owner):
                    continue
                hashes = words.hashes()
                grams = runs_hash(hashes, GRAM)
                # The minimiser again: the least gram of the first window.
                key = np.array([grams[a: a + WIDTH].min() for a in first.tolist()], np.uint64).view(np.int64)
                single = splits[np.minimum(np.searchsorted(splits, key), len(splits) - 1)] == key if len(splits) else np.zeros(len(key), bool)
                n = np.where(single, count, 1)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner, key, single = (np.repeat(x, n) for x in (owner, key, single))
                first, count = np.repeat(first, n) + np.where(single, nth, 0), np.where(single, 1, np.repeat(count, n))
                if single.any():
                    whole = runs_hash(hashes, LENGTH)
                    key = np.where(single, whole[np.minimum(first, len(whole) - 1)].view(np.int64), key)
                is_copy = column(part, "is_copy")[owner]
                place = packed(first - words.heads[owner], count, column(part, "mark")[owner])
                told_row, told_place = [], []
                for k, f, c, s, r, p, copy in zip(
                        key.tolist(), first.tolist(), count.tolist(), single.tolist(), column(part, "row")[owner].tolist(), place.tolist(), is_copy.tolist(), strict=True):
                    string = words.string(f, c + LENGTH - 1)
                    there = held.get((string, s))
                    if there is None:
                        held[string, s] = [k, 2, None, None] if copy else [k, 1, r, p]
                        size += len(string) + 200
                        continue
                    if there[2] is not None:
                        told_row.append(there[2])
                        told_place.append(there[3])
                        there[1:] = [2, None, None]
                    if not copy:
                        told_row.append(r)
                        told_place.append(p)
                if told_row:
                    yield known(told_row, told_place)
                if size >= HELD_BYTES:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    return run


def repeated_windows(strings: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first window and number of windows of the runs of windows that occur more than once in all.

    Words are numbered by their bytes; then pairs of neighbouring numbers are numbered, which gives ranks
    of 2, 4, ... words and last, by an overlapping pair, of LENGTH: equal ranks are equal windows.
    """
    body, ends = byte_view(strings)
    gap = np.flatnonzero(body == 32)
    starts = np.union1d(ends[:-1], gap + 1)
    stops = np.union1d(ends[1:], gap)
    take = np.ones(len(body), bool)
    take[gap] = False
    offsets = np.append(0, np.cumsum(stops - starts))
    ranks = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body[take]))]).dictionary_encode().indices.to_numpy().astype(np.int64)
    heads = np.searchsorted(starts, ends)
    width = 1
    while width < LENGTH:
        step = min(width, LENGTH - width)
        n = len(ranks) - step
        _, ranks = np.unique(ranks[:n] << 32 | ranks[step:], return_inverse=True)
        width += step
    count = np.diff(heads) - LENGTH + 1
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    classes = ranks[heads[:-1][owner] + nth]
    again = np.bincount(classes, weights=times[owner])[classes] > 1
    opens = again.copy()
    opens[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
    closes = again & np.append(~again[1:] | (owner[1:] != owner[:-1]), True)
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    return owner[a], nth[a], b - a + 1


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows, from strings sorted by key and words."""
    held: list[pa.RecordBatch] = []
    size = 0
    waiting: tuple | None = None  # the last single window: words, row and place, None once known to be repeated

    def out(row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int64())], ["row", "place"])

    def judged(rows: pa.Table) -> pa.RecordBatch:
        # Buckets are judged together: a window's minimiser is part of it, so other buckets have no equal windows.
        times = column(rows, "times").astype(np.int64)
        owner, nth, count = repeated_windows(rows["words"].combine_chunks(), times)
        mine = times[owner] == 1
        owner, nth, count = owner[mine], nth[mine], count[mine]
        first, _, mark = unpacked(rows["place"].fill_null(0).to_numpy()[owner])
        return out(rows["row"].fill_null(0).to_numpy()[owner], packed(first + nth, count, mark))

    for batch in batches:
        known = batch.filter(batch.column(1).is_null())
        if known.num_rows:
            yield out(column(known, "row"), column(known, "place"))
        batch = batch.filter(batch.column(1).is_valid())
        single = column(batch, "single").astype(bool)
        alone = batch.filter(pa.array(single))
        row, place = [], []
        for words, times, r, p in zip(*(alone.column(alone.schema.get_field_index(c)).to_pylist() for c in ("words", "times", "row", "place")), strict=True):
            if waiting is not None and waiting[0] == words:
                if waiting[1] is not None:
                    row.append(waiting[1])
                    place.append(waiting[2])
                    waiting = (words, None, None)
                if r is not None:
                    row.append(r)
                    place.append(p)
            else:
                waiting = (words, r, p)
        if row:
            yield out(np.array(row, np.int64), np.array(place, np.int64))
        rows = batch.filter(pa.array(~single))
        if not rows.num_rows:
            continue
        key = column(rows, "key")
        start = 0
        for cut in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
            new = start > 0 or not held or held[-1].column(0)[-1].as_py() != key[0]
            if new and size >= SORTED_BYTES:
                yield judged(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(rows.slice(start, cut - start))
            size += int(byte_view(held[-1].column(1))[1][-1])
            start = cut
    if held:
        yield judged(pa.Table.from_batches(held))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words under repeated windows."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            words = Words(part.column(part.schema.get_field_index("text")))
            places = part.column(part.schema.get_field_index("places"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
            first, count, mark = unpacked(places.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            mine = (mark == column(part, "mark")[owner]) & (count > 0)
            first, count = first[mine] + words.heads[owner[mine]], count[mine]
            n = len(words.offsets) - 1
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + count + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.diff(words.heads)
            whole = column(part, "is_copy").astype(bool) & (total >= LENGTH)
            gone |= np.repeat(whole, total)
            kept = words.bytes[np.repeat(~gone, np.diff(words.offsets))]
            sizes = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(words.offsets)))])
            ends = sizes[words.heads]
            texts = [kept[a: max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cut = np.concatenate([[0], np.cumsum(gone)])[words.heads]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(total.astype(np.int64)), pa.array(np.diff(cut).astype(np.int64)), pa.array(texts, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_text (the kept words, a blank between each, in UTF-8)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = rows.withColumn("d", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(LENGTH), "text"))
    texts = digests.select("doc_id", "text", F.xxhash64("doc_id", "d", "d2").alias("row"), F.pmod("d", F.lit(1 << MARK_BITS)).alias("mark"))
    n = max(tasks_for(docs, TEXT_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))

    keys = digests.where(F.octet_length("text") >= 2 * LENGTH - 1).select("d", "d2", F.xxhash64("doc_id", "d", "d2").alias("row"))
    groups = keys.groupBy("d", "d2").agg(F.min("row").alias("speaker"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = staged(keys.join(groups, ["d", "d2"]).select("row", (F.col("row") == F.col("speaker")).alias("speaks")), "copies")

    members = texts.select("text", "row", "mark").mapInArrow(found_minimisers, MEMBERS)
    asked = members.repartition(n, "key").sortWithinPartitions("key")
    minimisers = staged(asked.mapInArrow(repeated_minimisers(HOT), "row long, place long, hot long, times long"), "minimisers")
    places = minimisers.where("row IS NOT NULL").select("row", "place")
    least = max(HOT, places.count() // HOT_KEYS)  # so that at most HOT_KEYS minimisers are hot
    hot = np.sort(np.array([r[0] for r in minimisers.where(F.col("times") >= least).select("hot").collect()], np.int64))
    splits = spark.sparkContext.broadcast(hot)

    def with_places(places: DataFrame, kind: str) -> DataFrame:
        """Texts with the places of a row and whether it is a copy."""
        marks = copies.select("row", F.lit(COPY).cast("long").alias("place"), F.lit(True).alias("is_copy"), "speaks")
        both = places.select("row", "place", F.lit(False).alias("is_copy"), F.lit(False).alias("speaks")).unionByName(marks)
        of_row = both.groupBy("row").agg(F.collect_list(F.when(F.col("place") >= 0, F.col("place"))).alias("places"), F.max("is_copy").alias("is_copy"), F.max("speaks").alias("speaks"))
        joined = texts.repartition(n, "row").join(of_row.repartition(n, "row"), "row", kind)
        empty = F.array().cast("array<long>")
        return joined.select("doc_id", "text", "row", "mark", F.coalesce("places", empty).alias("places"),
                             F.coalesce("is_copy", F.lit(False)).alias("is_copy"), F.coalesce("speaks", F.lit(False)).alias("speaks"))

    asking = with_places(places, "inner").where("size(places) > 0 AND (speaks OR NOT is_copy)").select("text", "row", "mark", "places", "is_copy")
    strings = asking.mapInArrow(strings_of(splits), STRINGS)
    found = staged(strings.repartition(n, "key").sortWithinPartitions("key", "words").mapInArrow(counted, "row long, place long"), "repeated")
    return with_places(found, "left").select("doc_id", "text", "mark", "places", "is_copy").mapInArrow(
        removed, "doc_id long, n_words long, n_removed long, kept_text binary")
