"""Near-duplicate documents by SuperMinHash.

A document's set is its distinct five-word shingles. For each element a pseudo-random permutation of
the SIGNATURE slots is drawn step by step; at step j the element offers the value j plus a fraction
to the slot that comes j-th in its permutation, and each slot keeps the least offer. The slots are
correlated (an element visits each of them once), which lowers the variance, and a document stops at
the step that no offer can improve any more.

Bands of ROWS slots give buckets. Every document of a bucket is put with the bucket's smallest
document, its leader: two documents that share a bucket share its leader, so all candidate pairs meet in
some leader's group, each document sent once per leader and not once per band. Groups are compared in
tiles of bounded size by exact intersection counts of the full sets, which confirm or drop each pair;
a tile returns a spanning forest of its links. Union of the links gives the groups.

Equal sets are one node from the start, so copies cost a hash each and never meet as pairs.

At the threshold of 0.85 a pair shares none of the 25 bands of 5 slots with probability 4e-7, at one
of 0.80 with 5e-5.

Defined cases: a document without words has an empty set and links with nothing; rows with equal
doc_id are one node; a class without any doc_id links with nothing and its component_id is null;
ties and repeated rows share their class; an empty table gives an empty result; texts of any length
are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.common import mixed, pieces, texts_of
from steward.llm.components import components
from steward.llm.groups import clustered, groups
from steward.llm.shingles import shingle_sets
from steward.staging import staged

BANDS, ROWS = 25, 5
SIGNATURE = BANDS * ROWS
#: Similarity in percent where the caller names none, documents of a tile's side, and bytes of text worked on at once.
PERCENT, BLOCK, PIECE = 85, 256, 1 << 20
_STEP = np.uint64(48)
_FRACTION = np.uint64((1 << 48) - 1)
_GOLDEN = 0x9E3779B97F4A7C15
FEATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"
SETS = "node long, shingles binary"


def _draws(elements: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The place swapped in at this step, and the offer."""
    bits = mixed(elements + np.uint64((step + 1) * _GOLDEN % (1 << 64)))
    place = step + ((bits >> _STEP) * np.uint64(SIGNATURE - step) >> np.uint64(16)).astype(np.int64)
    return place, (np.uint64(step) << _STEP) | (bits & _FRACTION)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SIGNATURE slots per set; sets aren't empty."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    slots = np.full((len(sets), SIGNATURE), ~np.uint64(0))
    flat = slots.reshape(-1)
    place, offer = _draws(elements, 0)
    np.minimum.at(flat, owner * SIGNATURE + place, offer)
    order: np.ndarray | None = None
    for step in range(1, SIGNATURE):
        open_sets = slots.max(axis=1) >= np.uint64(step) << _STEP
        go = open_sets[owner]
        if not go.any():
            break
        if order is None:  # permutations of those that go on, after their first step
            owner, elements, place = owner[go], elements[go], place[go]
            order = np.tile(np.arange(SIGNATURE, dtype=np.uint8), (len(owner), 1))
            order[np.arange(len(owner)), place] = 0
            order[:, 0] = place
        elif not go.all():
            owner, elements, order = owner[go], elements[go], order[go]
        place, offer = _draws(elements, step)
        rows = np.arange(len(owner))
        slot = order[rows, place]
        order[rows, place] = order[:, step]
        order[:, step] = slot
        np.minimum.at(flat, owner * SIGNATURE + slot, offer)
    return slots


def band_keys(slots: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(slots), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + slots[:, r::ROWS][:, :BANDS] + np.uint64(r + 1))
    return mixed(keys + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            sets = shingle_sets(texts_of(piece, "text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                    bands[i] = row
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), *piece.columns[2:]], ["doc_id", "n_shingles", "set_key", "bands", *piece.schema.names[2:]])


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of joined rows (node, set_key, text) whose text has that key; rows of one node
    follow each other, and repeated ones are left out."""
    last, seen = None, set()
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            nodes, bodies = [], []
            sets = shingle_sets(texts_of(piece, "text"))
            for node, key, s in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), sets, strict=True):
                if node != last:
                    last, seen = node, set()
                if not len(s) or key in seen:
                    continue
                body = s.tobytes()
                if hashlib.blake2b(body, digest_size=16).digest() == key:
                    seen.add(key)
                    nodes.append(node)
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], ["node", "shingles"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a tile's sets."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), c := len(np.intersect1d(*sets, assume_unique=True))], [c, len(sets[1])]], float)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.diff(values, prepend=values[:1]) != 0
    new[0] = True
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1  # elements of one set only add nothing
    keep = often[number]
    owner, number = owner[keep], (np.cumsum(often) - 1)[number[keep]]
    total = np.zeros((n, n), np.float64)
    width = 2048
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], number[a:b] - k * width] = 1
        total += block @ block.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def tile_links(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each tile: rows of (leader, side_a, side_b)."""
    us, vs = [], []
    for tile in groups(batches, ["leader", "side_a", "side_b"]):
        nodes = tile["node"].to_pylist()
        if len(nodes) < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile["shingles"].combine_chunks()]
        sizes = np.array([len(s) for s in sets], float)
        shared = shared_counts(sets)
        linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        a, b = np.nonzero(np.triu(linked, 1))
        for i, j in forest(len(nodes), zip(a.tolist(), b.tolist(), strict=True)):
            us.append(nodes[i])
            vs.append(nodes[j])
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(leader, node) of every document of a bucket with two or more, leaders included."""
    rows = classes.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    return rows.join(leaders, "bucket").select("leader", "node").distinct()


def tiles(members: DataFrame) -> DataFrame:
    """Members with the tiles they belong to: blocks of about BLOCK documents, paired."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(sizes, "leader").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.select("leader", "node", "block", others.alias("other")).select(
        "leader", "node", F.least("block", "other").alias("side_a"), F.greatest("block", "other").alias("side_b"))


def with_components(rows: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key and component of rows of (doc_id long, text), and their text_key if they have one."""
    keyed = [c for c in rows.columns if c == "text_key"]
    features = staged(rows.mapInArrow(featured, ", ".join([FEATURES, *(f"{c} string" for c in keyed)])), "features")
    rows = rows.select("doc_id", "text")
    full = features.where("set_key IS NOT NULL")
    classes = staged(full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    members = staged(candidate_groups(classes), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_key")
    found = rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "set_key", "text")
    sets = staged(found.mapInArrow(set_rows, SETS), "sets")
    tiled = tiles(members).join(sets, "node")
    links = clustered(tiled.select("leader", "side_a", "side_b", "node", "shingles"), ["leader", "side_a", "side_b"])
    roots = components(links.mapInArrow(lambda batches: tile_links(batches, percent), "u long, v long"))
    labelled = classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component"))
    return features.select("doc_id", "n_shingles", "set_key", *keyed).join(labelled, "set_key", "left")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept; links have `percent` similarity or more."""
    out = with_components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, with all its columns; documents without words all stay.

    The row is one of the group's least doc_id; of rows equal in id and text one stays. Rows of equal
    sets without any doc_id are a group.
    """
    row_id, text_key = F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key")
    out = with_components(docs.select(row_id, "text", text_key), percent)
    group = ["component", F.when(F.col("component").isNull(), F.col("set_key")).alias("key")]
    equal = out.where("set_key IS NOT NULL").groupBy(*group, "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")).alias("x")
    chosen = equal.groupBy("component", "key").agg(first).select("x.doc_id", "x.text_key", "x.n")
    wordless = out.where("set_key IS NULL").select("doc_id", "text_key", F.lit(1).cast("long").alias("n")).distinct()
    kept = staged(chosen.unionByName(wordless).select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), "n"), "kept")
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_id.alias("id"), text_key)
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return carried.join(kept, same, "left_semi").select("row.*")
    once = carried.join(repeated, same, "left_semi").groupBy("id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return carried.join(kept.where("n = 1"), same, "left_semi").select("row.*").unionByName(once.select("row.*"))
