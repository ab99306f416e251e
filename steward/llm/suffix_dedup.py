"""Exact removal of repeated 100-byte strings by bucket refinement.

A byte goes when a 100-byte string over it also starts earlier: in a document with a smaller id, or
in the same one further left. The stages narrow the set of string starts by buckets:

1. Anchors. Every 100-byte string is put in the bucket of its least 24-gram (by hash, leftmost): equal
   strings have equal anchors. The starts that share an anchor are a run, a cell. Cells whose anchor
   occurs once in the corpus can't hold a repeated string and drop out.
2. Cells. Equal cells (all bytes of their strings) are one bucket; all but the first go as a whole.
3. Sides. A string reaches at least 38 bytes beyond its anchor on one side. A first cell stays in play
   only if the bucket of (anchor, left 38) or of (anchor, right 38) holds another cell.
4. Strings. The strings of the cells still in play are sorted by bucket pointers: 8-gram buckets are
   refined by the pair (own bucket, bucket 8 bytes on), the result by the pair 16 bytes on, then 32,
   then 36, each step reusing the pointers of the one before. That gives the classes of equal
   100-byte strings of a task exactly; one string per class goes on to meet those of other tasks.

A bucket is never gathered: each task finds the first member of every bucket among its own documents
and sends only that, so a bucket has one row per task at most, however many members it has; the
others are known to be repeats where they are found. Buckets that decide (cells, strings) have 128-bit
keys. Texts are shuffled once, into a table bucketed by document; every stage reads it in place and
only positions move.

Copies of a whole text are found by its SHA-256 first; they can hold no first occurrence.

Defined cases: a null text is empty; texts under 100 bytes never change; rows equal in id and text are
one document; texts that share an id are ordered by their digest; rows without id come first and
count as one document each per text; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steward.llm.common import byte_view, mixed, pieces, tasks_for, texts_of
from steward.llm.shingles import powers_to
from steward.staging import staged

LENGTH, GRAM, SIDE = 100, 24, 38
SPAN = LENGTH - GRAM + 1  # grams in a string
BUCKET_BYTES, PIECE, BLOCK = 12 << 20, 1 << 20, 1 << 22
#: Starts that a task collects before it sends the first member of each bucket.
LOCAL_ROWS = 1 << 21
NO_ID = -(1 << 63)
FOUND = "key long, k long, k2 long, doc long, u int, place long, sure boolean, more boolean"
PLACES = "doc long, u int, place long, first boolean"
_random = np.random.default_rng(7)
_TABLES = [_random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(body: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each position, built from runs of doubled length."""
    n = len(body) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, total, at, k = mixed(_TABLES[0][body]), np.zeros(n, np.uint64), 0, 1
    while k <= width:
        if width & k:
            total = total * np.uint64(pow(_BASE, k, 1 << 64)) + run[at: at + n]
            at += k
        run = run[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + run[k:]
        k *= 2
    return mixed(total)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Pieces:
    """Texts of a piece end to end, with the documents they belong to."""

    def __init__(self, batch: pa.RecordBatch):
        self.body, self.ends = byte_view(texts_of(batch, "text"))
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.doc = column("doc").to_numpy()
        self.u = column("u").to_numpy()
        self.places = column("places") if "places" in batch.schema.names else None

    def strings(self) -> np.ndarray:
        """Which positions begin a string within their document."""
        ok = np.zeros(len(self.body), bool)
        for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            ok[a: max(a, b - LENGTH + 1)] = True
        return ok

    def cells(self) -> tuple[np.ndarray, ...]:
        """Owner, first start, last start, anchor and the anchor's hash of every cell."""
        hashes, ok = gram_hashes(self.body, GRAM), self.strings()
        anchors = []
        for a in range(0, max(0, len(self.body) - LENGTH + 1), BLOCK):
            # Rank by hash, then by place: the least of a string is its leftmost least gram.
            block = hashes[a: a + BLOCK + SPAN - 1]
            ranked = (block & ~_LOW) | np.arange(len(block), dtype=np.uint64)
            anchors.append((least_of(ranked, SPAN) & _LOW).astype(np.int64) + a)
        if not anchors:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        anchor = np.concatenate(anchors)
        ok = ok[: len(anchor)]
        opens = ok.copy()
        opens[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        heads = self.ends[:-1]
        heads = heads[heads < len(ok)]
        opens[heads] = ok[heads]
        goes_on = np.append(ok[1:] & ~opens[1:], False)
        first, last = np.flatnonzero(opens), np.flatnonzero(ok & ~goes_on)
        owner = np.searchsorted(self.ends, first, side="right") - 1
        return owner, first, last, anchor[first], hashes[anchor[first]]

    def listed(self) -> tuple[np.ndarray, ...]:
        """Owner, first start, last start and anchor of the cells that the rows list."""
        offsets = self.places.offsets.to_numpy().astype(np.int64)
        packed = self.places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(self.doc)), np.diff(offsets))
        first = (packed >> 16) + self.ends[owner]
        return owner, first, first + (packed >> 8 & 255), first + (packed & 255)

    def sums(self) -> list[np.ndarray]:
        up, _ = powers_to(len(self.body) + 1)
        out = []
        for table in _TABLES:
            total = np.zeros(len(self.body) + 1, np.uint64)
            np.cumsum(table[self.body] * up[: len(self.body)], out=total[1:])
            out.append(total)
        return out

    def pack(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return (first - self.ends[owner]) << 16 | (last - first) << 8 | (anchor - first)


def keys_of(sums: list[np.ndarray], start: np.ndarray, stop: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the bytes from start to stop."""
    down = powers_to(len(sums[0]))[1][start]
    extra = (stop - start).astype(np.uint64) + np.uint64(salt << 32)
    return tuple(mixed((s[stop] - s[start]) * down + extra * np.uint64(2 * i + 1)).astype(np.int64) for i, s in enumerate(sums))


class Firsts:
    """Members of buckets as a task finds them; sends the first of each, and the others as repeats."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, k, k2, doc, u, place) -> Iterator[pa.RecordBatch]:
        self.rows.append((k, k2, doc.astype(np.int64), u.astype(np.int32), place))
        self.size += len(k)
        if self.size >= LOCAL_ROWS:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        k, k2, doc, u, place = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows, self.size = [], 0
        order = np.lexsort((place, u, doc, k2, k))
        members = [c[order] for c in (k, k2, doc, u, place)]
        new = np.ones(len(k), bool)  # a repeated row gives the same member again
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in members])
        k, k2, doc, u, place = (c[new] for c in members)
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        number = np.cumsum(head) - 1
        more = np.bincount(number)[number] > 1
        key = np.where(head, k, mixed((doc + place).view(np.uint64)).view(np.int64))
        columns = [key, k, k2, doc, u, place, ~head, more]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for a in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[a: a + (1 << 17)]) for c in columns], names)


def found_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Firsts()
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            p = Pieces(part)
            owner, first, last, anchor, hashes = p.cells()
            yield from out.add(hashes.view(np.int64), np.zeros(len(owner), np.int64), p.doc[owner], p.u[owner], p.pack(owner, first, last, anchor))
    yield from out.send()


def found_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Firsts()
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            p = Pieces(part)
            owner, first, last, anchor = p.listed()
            k, k2 = keys_of(p.sums(), first, last + LENGTH)
            yield from out.add(k, k2, p.doc[owner], p.u[owner], p.pack(owner, first, last, anchor))
    yield from out.send()


def found_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Firsts()
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            p = Pieces(part)
            owner, first, last, anchor = p.listed()
            sums, place = p.sums(), p.pack(owner, first, last, anchor)
            right, left = anchor + GRAM + SIDE <= p.ends[owner + 1], anchor - SIDE >= p.ends[owner]
            for salt, ok, start, stop in ((1, right, anchor, anchor + GRAM + SIDE), (2, left, anchor - SIDE, anchor + GRAM)):
                k, k2 = keys_of(sums, start[ok], stop[ok], salt)
                yield from out.add(k, k2, p.doc[owner[ok]], p.u[owner[ok]], place[ok])
    yield from out.send()


def string_classes(body: np.ndarray, starts: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Class numbers of the LENGTH-byte strings at `starts`, by bucket pointers.

    `alive` marks the positions whose pointers may be needed; at least LENGTH bytes follow each start.
    """
    at = np.flatnonzero(alive)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
    _, ids = np.unique(np.ascontiguousarray(grams).view(">u8").reshape(-1), return_inverse=True)
    bucket = np.zeros(len(body) + LENGTH, np.int64)
    bucket[at] = ids + 1
    for step in (8, 16, 32, LENGTH - 64):
        pairs = bucket[at] << 32 | bucket[at + step]
        _, ids = np.unique(pairs, return_inverse=True)
        bucket[at] = ids + 1
    return bucket[starts]


def found_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Firsts()
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            p = Pieces(part)
            owner, first, last, _ = p.listed()
            if not len(owner):
                continue
            count = last - first + 1
            who = np.repeat(owner, count)
            start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            alive = np.zeros(len(p.body) + LENGTH, np.int32)
            np.add.at(alive, start, 1)
            np.add.at(alive, start + LENGTH, -1)
            alive = np.cumsum(alive)[: len(p.body)] > 0
            classes = string_classes(p.body, start, alive)
            _, example, class_of = np.unique(classes, return_index=True, return_inverse=True)
            k, k2 = keys_of(p.sums(), start[example], start[example] + LENGTH)
            yield from out.add(k[class_of], k2[class_of], p.doc[who], p.u[who], (start - p.ends[who]) << 16)
    yield from out.send()


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated members of buckets with whether they are the first, from rows sorted by key."""
    held: pa.Table | None = None

    def judged(rows: pa.Table) -> pa.RecordBatch:
        k, k2, doc, u, place, sure, more = (rows[c].to_numpy() for c in ("k", "k2", "doc", "u", "place", "sure", "more"))
        asked = np.flatnonzero(~sure)
        new = np.ones(len(asked), bool)  # tasks may have parts of the same repeated rows
        new[1:] = np.logical_or.reduce([c[asked][1:] != c[asked][:-1] for c in (k, k2, doc, u, place)])
        more = np.bitwise_or.reduceat(more[asked], np.flatnonzero(new)) if len(asked) else more[asked]
        asked = asked[new]
        head = np.ones(len(asked), bool)
        head[1:] = (k[asked][1:] != k[asked][:-1]) | (k2[asked][1:] != k2[asked][:-1])
        number = np.cumsum(head) - 1
        repeated, first = sure.copy(), np.zeros(len(k), bool)
        repeated[asked] = (np.bincount(number, minlength=1)[number] > 1) | more
        first[asked] = head
        keep = np.flatnonzero(repeated)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(u[keep]), pa.array(place[keep]), pa.array(first[keep])], ["doc", "u", "place", "first"])

    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not rows.num_rows:
            continue
        k, k2 = rows["k"].to_numpy(), rows["k2"].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield judged(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield judged(held)


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts with the bytes to remove (places: first and last start) taken out."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            p = Pieces(part)
            copy = part.column(part.schema.get_field_index("is_copy")).to_numpy(zero_copy_only=False)
            owner, first, last, _ = p.listed()
            edge = np.zeros(len(p.body) + 1, np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            sizes, cut, spans, kept = [], [], [], []
            for i, (a, b) in enumerate(zip(p.ends[:-1].tolist(), p.ends[1:].tolist(), strict=True)):
                mask = gone[a:b]
                if copy[i] and b - a >= LENGTH:
                    mask = np.ones(b - a, bool)
                sizes.append(b - a)
                cut.append(int(mask.sum()))
                spans.append(int(mask[:1].sum() + np.count_nonzero(mask[1:] & ~mask[:-1])))
                kept.append(p.body[a:b][~mask].tobytes())
            doc_id = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(sizes, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_bytes."""
    spark = docs.sparkSession
    n = max(tasks_for(docs, BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("digest", F.sha2("text", 256))
    of_id = Window.partitionBy("doc").orderBy("digest")
    numbered = rows.repartition(n, "doc").withColumn("u", (F.dense_rank().over(of_id) - 1).cast("int"))
    name = f"texts_{uuid.uuid4().hex}"
    numbered.write.bucketBy(n, "doc").option("compression", "zstd").format("parquet").saveAsTable(name)
    texts = spark.table(name)

    keys = texts.select("doc", "u", "digest")
    firsts = keys.groupBy("digest").agg(F.min(F.struct("doc", "u")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = staged(keys.join(firsts, "digest").where(F.struct("doc", "u") > F.col("first")).select("doc", "u").distinct(), "copies")

    def joined(evidence: DataFrame, kind: str) -> DataFrame:
        side = evidence.select(F.col("doc").alias("its_doc"), F.col("u").alias("its_u"), *(c for c in evidence.columns if c not in ("doc", "u")))
        # One key, so that the table's buckets serve; `u` is a residual condition.
        match = (F.col("doc") == F.col("its_doc")) & (F.col("u") - F.col("its_u") == 0)
        return texts.join(side.hint("shuffle_hash"), match, kind).drop("its_doc", "its_u")

    def listed(places: DataFrame) -> DataFrame:
        return places.groupBy("doc", "u").agg(F.collect_set("place").alias("places"))

    def repeated(found: DataFrame, name: str) -> DataFrame:
        dealt = found.repartition("key").sortWithinPartitions("k", "k2", "doc", "u", "place")
        return staged(dealt.mapInArrow(settled, PLACES), name)

    def pass_over(places: DataFrame) -> DataFrame:
        return joined(listed(places), "inner").select("doc", "u", "text", "places")

    originals = joined(copies.withColumn("is_copy", F.lit(True)), "left").where(F.col("is_copy").isNull() & (F.octet_length("text") >= LENGTH))
    anchors = repeated(originals.select("doc", "u", "text").mapInArrow(found_anchors, FOUND), "anchors")
    cells = repeated(pass_over(anchors).mapInArrow(found_cells, FOUND), "cells")
    whole = cells.where("NOT first").select("doc", "u", "place").distinct()
    first_cells = anchors.select("doc", "u", "place").join(whole, ["doc", "u", "place"], "left_anti")
    sides = repeated(pass_over(first_cells).mapInArrow(found_sides, FOUND), "sides")
    strings = repeated(pass_over(sides).mapInArrow(found_strings, FOUND), "strings")
    gone = whole.unionByName(strings.where("NOT first").select("doc", "u", "place"))
    evidence = listed(gone).join(copies.withColumn("is_copy", F.lit(True)), ["doc", "u"], "full").select(
        "doc", "u", F.coalesce("places", F.array().cast("array<long>")).alias("places"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"))
    last = joined(evidence, "left").select(
        "doc_id", "doc", "u", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"))
    return last.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
