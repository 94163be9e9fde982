"""Exact top-k inner products by the three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import meet, one_a_key, ranked, usable

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Queries of a block: with a shard's rows they make the matrices of partial scores that a task holds.
BLOCK_QUERIES = 256


def whole(m: np.ndarray) -> np.ndarray:
    """Python's integers, for products that may reach 2**53."""
    return np.vectorize(int, otypes=[object])(m)


def longs(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what doesn't fit becomes the nearest that does."""
    return np.clip(x, LEAST, MOST).astype(np.int64) if x.dtype == object else x.astype(np.int64)


def floors(df: DataFrame, scale: float) -> DataFrame:
    """floor(scale * x) of every component of `vector`, in double: whole numbers beyond 2**53 stay as they are, since Spark's
    floor ends at 64 bits."""

    def floor(x: Column) -> Column:
        return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)

    return df.withColumn("vector", F.transform("vector", lambda x: floor(x * scale)))


def lists(dim: int, n: int) -> list[slice]:
    """The components of each of the n score lists that a total score is the sum of."""
    ends = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, n_lists: int = 2) -> DataFrame:
    """The k highest inner products of floor(scale * x) vectors with each query: query_id, rank, vec_id, score, exactly.

    The components are cut into n_lists runs; each shard holds, for each run, the list of its vectors' partial scores. A
    total is the sum of n_lists partial scores, so a vector with total t has one of at least t / n_lists. Three phases:
    1. each list gives its k highest entries; their totals are looked up, and the k-th highest total of a query is its
       cutoff, which the k best can't be below;
    2. the cutoff goes to all shards with the queries, and each list gives all entries of at least cutoff / n_lists;
    3. a vector's entries are summed; those with lists missing stay only if the most these may add lifts them to the cutoff,
       and get their exact score from the vectors.
    No candidate is left out, so the answer is exact, ties included. As a shard holds whole vectors, it joins the lists of
    phase 2 and resolves the rest of phase 3 by itself: only scores that reach the cutoff leave it. The cutoffs travel as a
    column of the queries, so nothing that grows is broadcast.

    Rows whose vector is null or empty or holds null or non-finite components take no part on either side, nor do rows
    without a key; vectors of different lengths don't meet. A query doesn't find rows with its own key. Of queries that share
    a key the one with the least vector counts; repeated rows are found each. Scores beyond 64 bits become the nearest long. An
    empty table gives none, and other columns are ignored.
    """

    rows = floors(usable(vectors, key, vector, zeros=True), scale)
    asked = floors(one_a_key(usable(queries, key, vector, zeros=True)), scale)

    def shard(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return own["vec_id"].to_numpy(np.int64), np.stack(own["vector"].to_numpy())

    def partial(x: np.ndarray, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(rows, queries, partial scores of every list); doubles where they are exact, else Python's integers."""
        q = np.stack(block["vector"].to_numpy())
        if max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) >= 1 << 20 or x.shape[1] >= 1 << 12:
            x, q = whole(x), whole(q)
        return x, q, [q[:, s] @ x[:, s].T for s in lists(x.shape[1], n_lists)]

    def gather(own: tuple[np.ndarray, np.ndarray], block: pd.DataFrame) -> pd.DataFrame:
        ids, asked_ids = own[0], block["vec_id"].to_numpy(np.int64)
        _, _, parts = partial(own[1], block)
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        for i, a in enumerate(asked_ids):
            other = np.flatnonzero(ids != a)
            if len(other):
                n = min(k, len(other))
                at = np.unique([other[np.argpartition(-p[i, other], n - 1)[:n]] for p in parts])
                out.append(pd.DataFrame({"query_id": a, "vec_id": ids[at], "score": longs(sum(p[i, at] for p in parts))}))
        return pd.concat(out, ignore_index=True)

    first = meet(rows, asked, gather, "query_id long, vec_id long, score long", block_queries=BLOCK_QUERIES, prepare=shard)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cutoffs = first.withColumn("_r", best).where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    # a query with fewer than k others has no cutoff: all of them count
    asked = checkpointed(asked.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(LEAST))))

    def collect(own: tuple[np.ndarray, np.ndarray], block: pd.DataFrame) -> pd.DataFrame:
        ids, asked_ids = own[0], block["vec_id"].to_numpy(np.int64)
        x, q, parts = partial(own[1], block)
        cutoff = np.array([int(c) for c in block["cutoff"]], dtype=object)
        least = -(-cutoff // n_lists)
        exact = x.dtype == object
        at_least = (least if exact else least.astype(float))[:, None]
        known, seen = 0, np.zeros(parts[0].shape, np.int8)
        for p in parts:
            entry = p >= at_least
            known = known + np.where(entry, p, 0)
            seen += entry
        # what lists without an entry may add: each less than cutoff / n_lists
        reach = known + (n_lists - seen) * (at_least - 1) >= (cutoff if exact else cutoff.astype(float))[:, None]
        open_ = (cutoff == LEAST)[:, None] | ((seen > 0) & reach)
        i, j = np.nonzero(open_ & (asked_ids[:, None] != ids[None, :]))
        score = known[i, j]
        late = np.flatnonzero(seen[i, j] < n_lists)
        score[late] = (q[i[late]] * x[j[late]]).sum(1)
        score = longs(score)
        keep = score >= cutoff[i].astype(np.int64)
        return pd.DataFrame({"query_id": asked_ids[i[keep]], "vec_id": ids[j[keep]], "score": score[keep]})

    return ranked(meet(rows, asked, collect, "query_id long, vec_id long, score long", block_queries=BLOCK_QUERIES, prepare=shard), k)
