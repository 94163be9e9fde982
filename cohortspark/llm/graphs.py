"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root: the least node reachable) for every node of edges (a, b: long); nodes without edges aren't in it.

    Rounds of large stars and small stars: every node hangs its larger neighbours, then its smaller ones, on the least of
    them, until nothing changes, which takes about as many rounds as the logarithm of a component's diameter. What a round
    makes is written and read back, and removed a round later: files have a size that Spark knows, while a checkpoint keeps
    the estimate of its plan, in which every join multiplies those of its sides, so that the driver would hold numbers of
    four times as many digits after each round. Nodes with very many edges are aggregated before the shuffle, and the joins
    back to the edges have both sides shuffled for the join alone, so that Spark splits such a node's rows.
    """
    spark, paths = edges.sparkSession, []

    def kept(e: DataFrame) -> DataFrame:
        out, path = written(e, "edges")
        paths.append(path)
        return out

    def sides(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        both = sides(now)
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, mark(now)
        while len(paths) > 1:
            removed(spark, paths.pop(0))
        if before == seen:
            break
    out = checkpointed(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    removed(spark, paths.pop())
    return out
