"""Vector tables for searches: which rows take part, and how queries and rows meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Rows of a shard and queries of a block: what one task holds of either side.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024


def usable(vectors: DataFrame, key: str, vector: str, zeros: bool, *more: str) -> DataFrame:
    """(vec_id, vector: array<double>, further columns, dim) of the rows whose vector isn't null or empty and whose components are all finite
    (and, without `zeros`, not all zero). Rows without a key take no part either."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector"), *more).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~bad)
    if not zeros:
        df = df.where(F.exists("vector", lambda x: x != 0))
    return df.withColumn("dim", F.size("vector"))


def one_a_key(queries: DataFrame, *more: str) -> DataFrame:
    """Of queries that share a vec_id, the one with the least vector."""
    return queries.groupBy("vec_id").agg(F.min(F.struct("vector", "dim", *more)).alias("q")).select("vec_id", "q.*")


def meet(rows: DataFrame, queries: DataFrame, found: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, prepare: Callable[[pd.DataFrame], Any] = lambda rows: rows) -> DataFrame:
    """found(prepare(rows of a shard), queries of a block) for every pair of a shard and a block with vectors of the same length.

    A stated query set against all rows: rows are dealt over shards by a hash of their id and move once; the queries go to
    every shard. A task meets a shard's rows first, prepares them once, and takes the queries block by block as they come,
    so it holds about shard_rows rows and block_queries queries, however many there are of either.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("_asks", F.lit(False))
    queries = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_asks", F.lit(True))
    both = rows.unionByName(queries, allowMissingColumns=True).repartition(shuffle_partitions(rows.sparkSession), "dim", "_shard").sortWithinPartitions("dim", "_shard", "_asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[["dim", "_shard", "_asks"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                dim, shard, asks = marks[a]
                if (dim, shard) != key:
                    key, own, ready = (dim, shard), [], None
                if not asks:
                    own.append(batch.iloc[a:b])
                elif own or ready is not None:
                    if ready is None:
                        ready, own = prepare(pd.concat(own, ignore_index=True)), []
                    for i in range(a, b, block_queries):
                        yield found(ready, batch.iloc[i : min(i + block_queries, b)].reset_index(drop=True))

    return both.mapInPandas(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query with their rank from 1, ties to the smaller vec_id."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
