"""Connected components of long edge lists, by alternating large and small stars.

Every round points the neighbours of each node at its smallest neighbour; no group is gathered, and
a hub's rows are split by the skew join. Rounds grow with the logarithm of the longest path. Each
round is a written table, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.staging import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u long, v long): root is the smallest node reachable."""
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = staged(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = staged(stars.where("u <> v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
