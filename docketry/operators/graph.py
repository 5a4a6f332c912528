"""Connected components by alternating large-star and small-star steps; no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` (longs or strings, any order, repeats allowed); the root is the least node.

    Each round groups by node with a map-side minimum and joins the minimum back, so a node with very
    many links is pre-aggregated and its join can be split. Rounds grow with the logarithm of the longest chain;
    each is cut by a reliable checkpoint. No links give an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = cut(edges), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        hung = large.join(least, F.col("u") == F.col("n")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
