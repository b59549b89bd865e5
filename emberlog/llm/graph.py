"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): for each node that has an edge, the smallest node it can reach; roots have no row.

    edges holds pairs (a, b) of longs in either order. Each round hangs every neighbour of a node on the smallest
    one; the number of rounds grows with the logarithm of a component's size. Smallest neighbours come from a
    grouping that combines on the map side, so a hub with very many neighbours is one row for each task there. Each
    round is written to the shared folder, which cuts the lineage; only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(pairs, tag)
    before = _mark(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), tag)
        after = _mark(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
