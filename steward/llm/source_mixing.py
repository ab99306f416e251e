"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source, a histogram of words over the first 12 bits of the hash
shows in which bucket the budget runs out; only that boundary bucket is looked at again with 12 more
bits, down to one hash value. Documents below the resulting threshold are taken: a filter, no sort
of documents. Budgets nest: a larger target takes a superset of the documents.

Targets: sources in code point order, null last, get the weights in turn and share `share` of all
words; a target stops at `cap` times its source, and the excess goes to the others by weight.

Defined cases: a null text has no words; null is a source of its own; documents equal in id and
text have one hash and are taken alike; an empty table gives an empty result; a source of no words
gets target 0. Other columns are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steward.llm.common import BLANK
from steward.staging import staged

WEIGHTS = (3, 1, 2)
#: Share of all words as numerator and denominator, and the most copies of a document.
SHARE, CAP = (3, 2), 2
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources up to which the table of targets is broadcast; beyond it the join is salted.
BROADCAST_SOURCES, SALTS = 10_000, 32


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, and how often it is taken whole."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    num, den = SHARE
    per = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("long"))
    )
    ranked = per.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    # Sources by size to weight: those above their cap come first, so one pass finds them all.
    above = ranked.withColumn("above", F.col("weight") * (num * F.col("total") - den * CAP * F.col("smaller"))
                              > den * CAP * F.col("source_size") * F.col("rest"))
    shared = above.select(
        "source", "source_size", "weight", "above",
        (num * F.col("total") - den * CAP * F.coalesce(F.sum(F.when(F.col("above"), F.col("source_size"))).over(everything), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("above"), F.col("weight"))).over(everything).alias("open"),
    )
    target = F.when(F.col("above"), (CAP * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("left")).cast("double") / (den * F.col("open")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        shared.select("source", "source_size", target.alias("target"))
        .withColumn("whole", whole)
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def by_source(rows: DataFrame, small: DataFrame, few: bool, kind: str = "inner") -> DataFrame:
    """Join `rows` (source, h, ...) with one row per source, both null-safe."""
    if few:
        right = F.broadcast(small.withColumnRenamed("source", "its_source"))
        return rows.join(right, F.col("source").eqNullSafe(F.col("its_source")), kind).drop("its_source")
    right = small.withColumnRenamed("source", "its_source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = F.col("source").eqNullSafe(F.col("its_source")) & (F.pmod(F.col("h"), F.lit(SALTS)) == F.col("salt"))
    return rows.join(right, match, kind).drop("its_source", "salt")


def thresholds(sized: DataFrame) -> tuple[DataFrame, bool]:
    """Targets with the hash threshold of each source, and whether the table is small.

    `sized` has source, size and h. A document is taken once more than `whole` times when h lies
    below `at`, or equals it and `take_at` holds (at least half of that last hash fits).
    """
    targets = staged(source_targets(sized), "targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    state = targets.select("source", "budget", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("at"))
    for done in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - done
        bucket = F.shiftright("h", shift)
        inside = by_source(sized, state, few).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("at"))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        edge = summed.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
        state = edge.select("source", "budget", "before", F.col("bucket").alias("at"), "words")
    last = state.select("source", "at", (2 * (F.col("budget") - F.col("before")) >= F.col("words")).alias("take_at"))
    last = last.withColumnRenamed("source", "its_source")
    joined = targets.join(last, F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
    return staged(joined, "thresholds"), few


def with_copies(rows: DataFrame, limits: DataFrame, few: bool) -> DataFrame:
    """`rows` (source, size, h, ...) with source_size, target and copies."""
    once = F.coalesce((F.col("h") < F.col("at")) | ((F.col("h") == F.col("at")) & F.col("take_at")), F.lit(False))
    return by_source(rows, limits, few).withColumn("copies", F.col("whole") + once.cast("long")).drop("whole", "budget", "at", "take_at")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    slim = staged(sized(docs), "sizes")
    limits, few = thresholds(slim)
    return with_copies(slim, limits, few).drop("h").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, all columns kept."""
    limits, few = thresholds(staged(sized(docs), "sizes"))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("source"),
        document_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = with_copies(rows, limits, few).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
