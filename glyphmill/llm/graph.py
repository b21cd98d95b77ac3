"""Connected components by alternating star contractions, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its partners.  The minimum is combined before the shuffle; the join may be split by AQE where one u is hot."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) of longs -> (node, component): the smallest node reachable.  Nodes without a link to another node are absent.

    Null ends and self links are ignored; repeated links count once.  No links: no rows.
    Each round at least halves long chains, so rounds grow with the logarithm of the longest path.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
