"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one per half of the unit vectors, are fitted by k-means on a sample of at most SAMPLE
vectors; their product is a grid of cells, and every vector lies in the cell of its nearest pair of
codewords. A vector visits cells in the order of the sum of the two distances. Only cells (i, j) of
the two sorted lists with (i + 1)(j + 1) <= T can be among the first T, which is what a multi-sequence
traversal walks through, so all vectors of a batch are traversed at once along that staircase. T is
the least number of cells that finds RECALL of neighbours put at cosine CALIBRATED from sample vectors.

Every visit is verified by cosine in double precision. A pair may be found from one side or both; the
member of the cell knows its own reach, so each side's link is counted exactly once. Cells are compared
in tiles of bounded size on both sides, as matrix products, and a tile returns counts per vector and
the edges of a spanning forest, never its pairs.

Equal vectors of one label are one node with a count from the start.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without label, link with nothing; vectors of different lengths don't link; a null vec_id keeps null in
component_id unless it has copies with an id; rows that share a vec_id are one node of the components,
and each counts its own links; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.components import components
from steward.llm.groups import clustered, groups
from steward.staging import staged

COSINE = 0.93
#: Vectors that codebooks are fitted on; vectors aimed at per cell; codewords of a half at most.
SAMPLE, PER_CELL, MOST_CODES = 16_384, 96, 512
#: Share of neighbours at this cosine that the traversal must reach, and cells visited at most.
RECALL, CALIBRATED = 0.995, 0.94
#: Vectors of a tile's sides.
MEMBERS, ASKING = 1024, 4096
VISITS = "node long, sub long, label int, dim int, cell long, home boolean, reach double"
LINKS = "node long, sub long, other long, n long"


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    # Scale first: squares of very large or small components would overflow or vanish.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ codes.T) + (codes * codes).sum(axis=1)[None, :], 0)


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, halves: list[np.ndarray], visits: int):
        self.halves, self.visits = halves, visits
        self.codes = len(halves[0])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.halves[0].shape[1]
        return [squared(x[:, :cut], self.halves[0]), squared(x[:, cut:], self.halves[1])]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.codes + b.argmin(axis=1)

    def order(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `most` cells of each vector in order, and the sums of distances."""
        (i, j), (a, b) = staircase(self.codes, most), self.distances(x)
        ia, ib = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        cost = np.take_along_axis(a, ia, 1)[:, i] + np.take_along_axis(b, ib, 1)[:, j]
        first = cost.argsort(axis=1, kind="stable")[:, :most]
        cells = ia[:, i] * self.codes + ib[:, j]
        return np.take_along_axis(cells, first, 1), np.take_along_axis(cost, first, 1)


def staircase(codes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(i, j) for i in range(codes) for j in range(min(codes, most // (i + 1)))]
    i, j = zip(*pairs, strict=True)
    return np.array(i), np.array(j)


def fitted(sample: np.ndarray, total: int) -> Grid:
    """Codebooks by k-means, and the visits that reach RECALL."""
    rng = np.random.default_rng(11)
    codes = int(min(MOST_CODES, max(1, len(sample) // 8), max(2, np.sqrt(total / PER_CELL))))
    cut = sample.shape[1] // 2
    halves = []
    for part in (sample[:, :cut], sample[:, cut:]):
        words = part[rng.choice(len(part), codes, replace=False)].copy()
        for _ in range(12):
            near = squared(part, words).argmin(axis=1)
            counts = np.bincount(near, minlength=codes)
            sums = np.zeros_like(words)
            np.add.at(sums, near, part)
            words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        halves.append(words)
    grid = Grid(halves, 1)
    some = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
    aside = rng.standard_normal(some.shape) * (some != 0).any(axis=0)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    norms = np.linalg.norm(aside, axis=1, keepdims=True)
    moved = CALIBRATED * some + np.sqrt(1 - CALIBRATED**2) * aside / np.where(norms > 0, norms, 1)
    there = grid.home(moved)
    most = 4
    while True:
        cells, _ = grid.order(some, min(most, codes * codes))
        reached = (cells == there[:, None]).cumsum(axis=1).mean(axis=0)
        if reached[-1] >= RECALL or most >= codes * codes:
            enough = np.flatnonzero(reached >= RECALL)
            grid.visits = int(enough[0]) + 1 if len(enough) else codes * codes
            return grid
        most *= 2


def visited(batches: Iterator[pa.RecordBatch], grid: Grid, dim: int) -> Iterator[pa.RecordBatch]:
    """The cells that each vector visits; `reach` is the largest sum of distances it goes to."""
    most = min(grid.visits + 1, grid.codes**2)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            cells, cost = grid.order(padded(rows.column(4), dim), most)
            if most > grid.visits:  # between the last cell visited and the next
                reach, cells = (cost[:, -1] + cost[:, -2]) / 2, cells[:, :-1]
            else:
                reach = np.full(len(cells), np.inf)
            who = np.repeat(np.arange(rows.num_rows), cells.shape[1])
            home = np.zeros(cells.shape, bool)
            home[:, 0] = True
            columns = [rows.column(c).take(pa.array(who)) for c in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cells.reshape(-1), pa.int64()), pa.array(home.reshape(-1)), pa.array(reach[who])],
                [x.split()[0] for x in VISITS.split(", ")])


def tile_links(batches: Iterator[pa.RecordBatch], grid: Grid, dim: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Counts (other is null) and forest edges of each tile."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for tile in groups(batches, ["label", "dim", "cell", "member_block", "asking_block"]):
        member = tile["member"].to_numpy()
        if not member.any() or member.all():
            continue
        x = padded(tile["embedding"].combine_chunks(), dim)
        node, sub, copies, reach = (tile[c].to_numpy() for c in ("node", "sub", "copies", "reach"))
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        linked = x[q] @ x[m].T >= cosine
        linked &= (node[q][:, None] != node[m][None, :]) | (sub[q][:, None] != sub[m][None, :])
        if not linked.any():
            continue
        # Does the member visit the asking vector's cell? Then it counts that link there itself.
        a, b = grid.distances(x[m])
        home = grid.home(x[q])
        mutual = (a[:, home // grid.codes] + b[:, home % grid.codes]).T <= reach[m][None, :]
        for who, n in ((q, linked @ copies[m]), (m, (linked & ~mutual).T @ copies[q])):
            some = np.flatnonzero(n)
            for column, value in zip(out, (node[who[some]], sub[who[some]], np.full(len(some), -1), n[some]), strict=True):
                column.append(value)
        mark_m, mark_q = np.arange(len(m)), np.full(len(q), len(m))
        while True:  # least member reachable within the tile
            new_q = np.where(linked, mark_m[None, :], len(m)).min(axis=1)
            new_m = np.minimum(mark_m, np.where(linked, new_q[:, None], len(m)).min(axis=0))
            if (new_m == mark_m).all() and (new_q == mark_q).all():
                break
            mark_m, mark_q = new_m, new_q
        for who, mark in ((q, mark_q), (m, mark_m)):
            some = np.flatnonzero(mark < len(m))
            for column, value in zip(out, (node[who[some]], sub[who[some]], node[m[mark[some]]], np.zeros(len(some), np.int64)), strict=True):
                column.append(value)
        if sum(map(len, out[0])) > 1 << 18:
            yield _links(out)
            out = [[], [], [], []]
    if out[0]:
        yield _links(out)


def _links(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    node, sub, other, n = (np.concatenate(c).astype(np.int64) for c in out)
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(sub), pa.array(other, mask=n > 0), pa.array(n)], [x.split()[0] for x in LINKS.split(", ")])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    sound = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    good = rows.where(sound)
    classes = staged(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .withColumn("sub", F.xxhash64("label", "embedding")).withColumn("dim", F.size("embedding")), "vectors")
    indexed = classes.where("node IS NOT NULL")
    total, dim = indexed.agg(F.count(F.lit(1)), F.max("dim")).first()
    counts = edges = None
    if total:
        sample = indexed.orderBy(F.xxhash64("node", "sub"), "node").limit(SAMPLE).select("embedding").toArrow()
        grid = fitted(padded(sample["embedding"].combine_chunks(), dim), total)
        spread = indexed.select("node", "sub", "label", "dim", "embedding").repartition(
            max(1, min(100_000, -(-total // 20_000), 1 << 16)))
        visits = staged(spread.mapInArrow(lambda batches: visited(batches, grid, dim), VISITS), "visits")
        cell = ["label", "dim", "cell"]
        sizes = visits.groupBy(*cell).agg(F.count(F.lit(1)).alias("asking"), F.count_if("home").alias("members")).where("members > 0 AND asking > 1")
        member_blocks, asking_blocks = F.ceil(F.col("members") / MEMBERS).cast("int"), F.ceil(F.col("asking") / ASKING).cast("int")
        mixed = F.xxhash64("node", "sub")
        placed = visits.join(sizes.select(*cell, member_blocks.alias("mb"), asking_blocks.alias("ab")), cell)
        keep = ["node", "sub", "reach", *cell]
        asking = placed.select(*keep, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("member_block"),
                               F.pmod(mixed, F.col("ab")).cast("int").alias("asking_block"), F.lit(False).alias("member"))
        members = placed.where("home").select(*keep, F.pmod(mixed, F.col("mb")).cast("int").alias("member_block"),
                                              F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("asking_block"), F.lit(True).alias("member"))
        tiled = asking.unionByName(members).join(indexed.select("node", "sub", "copies", "embedding"), ["node", "sub"])
        key = [*cell, "member_block", "asking_block"]
        dealt = clustered(tiled.select(*key, "node", "sub", "member", "reach", "copies", "embedding"), key)
        links = staged(dealt.mapInArrow(lambda batches: tile_links(batches, grid, dim, cosine), LINKS), "embedding-links")
        counts = links.where("n > 0").groupBy("node", "sub").agg(F.sum("n").alias("n"))
        edges = components(links.where("n = 0").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = classes.select("label", "embedding", "node", "sub", "copies")
    if counts is None:
        known = known.withColumn("n", F.lit(0).cast("long")).withColumn("root", F.lit(None).cast("long"))
    else:
        known = known.join(counts, ["node", "sub"], "left").join(edges, "node", "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
