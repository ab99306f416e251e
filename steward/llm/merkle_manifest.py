"""Merkle manifest of a dataset, with proofs by nested intervals.

Every row is a leaf: a digest of all its columns. The leaves of a group (a language) have ranks by id;
a node of the tree above them carries the interval of leaf ranks it covers, `[lo, hi)`, beside its level.
Intervals nest: an ancestor's contains the node's, siblings share the parent's and are disjoint. So the
whole tree is one long table, and a proof is a join instead of a walk:

1. Ranks come from a range-partitioned sort: places within a partition plus the sizes of earlier ones.
2. Nodes are made in tiers of TIER levels. A group of 2**TIER neighbours (bounded, whatever the size of
   the language) gives all nodes above them up to its own top, which is an item of the next tier.
3. Every item asks, level by level, for the nodes whose interval its parent contains: a join on (tree,
   level, bucket of the level's parents) with the containment as condition. What the parent's interval
   has besides the item's own is the sibling.
4. An item of a tier takes the steps above its tier's top from the item of the next tier that contains it,
   so a node near the root meets 2**TIER items at most and not all leaves.

The subroots of the languages, in order, are the leaves of one more tree of the same kind.

Defined cases: a null column is `-` in the leaf's input, so null and the empty text differ; rows without
language are a language of their own, which comes first; rows without id come first in theirs; rows equal
in id are ordered by their digests, wholly equal rows by where they are read, which no result shows (their
proofs are dealt among them); a lone node is hashed alone on each level; an empty table gives an empty
result; texts of any length are hashed whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steward.llm.common import tasks_for
from steward.staging import staged

#: Levels of a tier: 2**TIER neighbours are gathered at once.
TIER = 10
RANK_BYTES = 32 << 20
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(framed(v) for v in values)), 256))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `rank` (from 0) within the group and `n`, the group's size; no group is gathered."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [*group, *order, "tie"]
    dealt = tied.repartitionByRange(tasks_for(rows, RANK_BYTES), *keys).sortWithinPartitions(*keys).drop("tie")
    placed = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranks")
    runs = placed.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *(F.col(c).alias(f"its_{c}") for c in group), F.col("part").alias("its_part"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy(*group)).alias("n"))
    match = F.col("part") == F.col("its_part")
    for c in group:
        match &= F.col(c).eqNullSafe(F.col(f"its_{c}"))
    joined = placed.join(offsets, match).withColumn("rank", F.col("at") + F.col("shift"))
    return joined.select(*rows.columns, "rank", "n")


def tier_nodes(items: DataFrame, base: int) -> DataFrame:
    """Nodes (tree, n, level, lo, hi, digest) of the levels base to base + TIER over items (tree, n, lo, digest)."""
    blocks = items.groupBy("tree", "n", F.shiftright("lo", base + TIER).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "digest"))).alias("members"))

    def above(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.transform(
            F.sequence(F.lit(0), ((F.size(last) - 1) / 2).cast("int")),
            lambda i: F.sha2(F.concat(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))), 256))
        return F.concat(levels, F.array(pairs))

    hexes = F.transform("members", lambda m: F.lower(F.hex(m["digest"])))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(TIER)), F.array(hexes), above)
    nodes = blocks.select("tree", "n", "block", F.posexplode(levels).alias("up", "digests")).select(
        "tree", "n", "block", (F.col("up") + base).alias("level"), F.posexplode("digests").alias("j", "digest"))
    width = F.expr("shiftleft(1L, level)")
    lo = F.shiftleft("block", base + TIER) + F.col("j") * width
    placed = nodes.select("tree", "n", "level", lo.alias("lo"), F.least(lo + width, F.col("n")).alias("hi"), F.unhex("digest").alias("digest"))
    # A tree ends at its first level of one node; the level below it has several, or is the leaves'.
    return placed.where((F.col("level") == base) | (F.expr("shiftleft(1L, level - 1)") < F.col("n")))


def tier_steps(items: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """(tree, lo, steps): per level of the tier below the tree's root, the item's sibling, if any."""
    levels = F.expr(f"filter(sequence({base}, {base + TIER - 1}), l -> shiftleft(1L, l) < n)")
    asks = items.select("tree", "n", "lo", F.explode(levels).alias("level")).withColumn("bucket", F.expr("shiftright(lo, level + 1)"))
    inner = nodes.select(
        F.col("tree").alias("its_tree"), F.col("level").alias("its_level"), F.expr("shiftright(lo, level + 1)").alias("its_bucket"),
        F.col("lo").alias("its_lo"), F.col("hi").alias("its_hi"), "digest")
    width = F.expr("shiftleft(1L, level)")
    own = F.col("lo") - F.col("lo") % width
    parent = F.shiftleft("bucket", 1) * width
    contained = (F.col("its_lo") >= parent) & (F.col("its_hi") <= F.least(parent + 2 * width, F.col("n")))
    sibling = (F.col("its_hi") <= own) | (F.col("its_lo") >= own + width)
    bucket = (F.col("tree") == F.col("its_tree")) & (F.col("level") == F.col("its_level")) & (F.col("bucket") == F.col("its_bucket"))
    found = asks.join(inner, bucket & contained & sibling, "left")
    step = F.struct("level", (F.col("its_lo") < F.col("lo")).alias("left"), "digest")
    return found.groupBy("tree", "lo").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of leaves (tree, n, lo, digest): nodes with their intervals, roots (tree, root), steps to the root (tree, lo, steps).

    A step is a level with the sibling's digest (null for a lone node) and whether it stands left.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    tiers, items, base = [], leaves, 0
    while base == 0 or most > 1 << base:
        nodes = staged(tier_nodes(items, base), "nodes")
        tiers.append((base, items, nodes))
        base += TIER
        items = nodes.where((F.col("level") == base) & (F.col("n") > 1 << base)).select("tree", "n", "lo", "digest")
    nodes, steps = None, None
    for base, items, made in reversed(tiers):
        mine = tier_steps(items, made, base)
        if steps is None:
            steps, nodes = mine, made
        else:
            upper = steps.select(F.col("tree").alias("its_tree"), F.shiftright("lo", base + TIER).alias("its_block"), F.col("steps").alias("more"))
            within = (F.col("tree") == F.col("its_tree")) & (F.shiftright("lo", base + TIER) == F.col("its_block"))
            joined = mine.join(upper, within, "left")
            steps = joined.select("tree", "lo", F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps"))
            # The top of a tier is the bottom of the next one.
            nodes = nodes.where(F.col("level") > base + TIER).unionByName(made)
    roots = nodes.where("lo = 0 AND hi = n").groupBy("tree").agg(F.min_by("digest", "level").alias("root"))
    return nodes, roots, steps


def folded(leaf: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (hex) gives with its steps."""
    sibling = lambda s: F.lower(F.hex(s["digest"]))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(
        F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(sibling(s), acc)).otherwise(F.concat(acc, sibling(s))), 256))


def siblings(steps: Column) -> Column:
    """The siblings' digests (hex) end to end."""
    there = F.filter(steps, lambda s: s["digest"].isNotNull())
    return F.array_join(F.transform(there, lambda s: F.lower(F.hex(s["digest"]))), "")


def manifest(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, lang, leaf, presented, subroot, root (hex) and steps from leaf to root.

    `presented` is the leaf of the row as someone else shows it: with the `changed` columns where
    `tampered` holds. `folded(presented, steps)` equals `root` only if it was not changed.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    shown = leaf_digest(list((columns | (changed or {})).values()))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest(list(columns.values())).alias("digest"),
        (F.lit(None) if tampered is None else F.when(tampered, shown)).cast("binary").alias("shown"))
    placed = staged(ranked(leaves, ["lang"], ["doc_id", "digest"]), "leaves")
    names = staged(ranked(placed.groupBy("lang").agg(F.max("n").alias("size")), [], ["lang"]), "groups")
    numbers = names.select(F.col("lang").alias("its_lang"), F.col("rank").alias("tree"))
    numbered = staged(placed.join(numbers, F.col("lang").eqNullSafe(F.col("its_lang"))).drop("its_lang"), "numbered")

    _, subroots, below = trees(numbered.select("tree", "n", F.col("rank").alias("lo"), "digest"))
    subroots = staged(subroots, "subroots")
    tops = names.select(F.col("rank").alias("tree"), "n").join(subroots, "tree").select(
        F.lit(0).cast("long").alias("tree"), "n", F.col("tree").alias("lo"), F.col("root").alias("digest"))
    _, root, above = trees(staged(tops, "tops"))
    upper = above.select(F.col("lo").alias("tree"), F.col("steps").alias("above"))
    per_tree = staged(subroots.withColumnRenamed("root", "subroot").join(upper, "tree", "left"), "upper")
    top = root.select("root").first()  # one digest
    rows = numbered.withColumnRenamed("rank", "lo").join(below, ["tree", "lo"], "left").join(per_tree, "tree")
    none = F.expr("cast(array() as array<struct<level: int, left: boolean, digest: binary>>)")
    return rows.select(
        "doc_id", "lang", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex(F.coalesce("shown", "digest"))).alias("presented"),
        F.lower(F.hex("subroot")).alias("subroot"), F.lit(top["root"].hex() if top else None).cast("string").alias("root"),
        F.concat(F.coalesce("steps", none), F.coalesce("above", none)).alias("steps"))
