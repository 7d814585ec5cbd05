"""Connected components of links by alternating large and small stars, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import stash

MOST_ROUNDS = 60


def _stars(pairs: DataFrame, keep: str) -> DataFrame:
    """(u, v) pairs with the least of u and its vs beside them; keep: which pairs go on."""
    least = stash(pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m")).where(keep)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of links (a, b).

    Each round writes its table, so a lost executor repeats one step at most; hot nodes
    are joined, never grouped, so that Spark can split them.
    """
    now = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(stash(large, "large"), "true")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        now = stash(small, "small")
        state = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first())
        if state == before:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
