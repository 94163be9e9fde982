"""Hard negatives by best-first search of packed R-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .topk import floors, longs, whole
from .vectors import meet, one_a_key, usable

#: Rows of a leaf and children of an inner node.
LEAF, FAN = 256, 16


class Windows:
    """For each of several windows of scores (both ends included) the k highest within it, ties to the smaller id."""

    def __init__(self, lows: list, highs: list, k: int, kind: type = float):
        self.low, self.high, self.k = np.array(lows, kind), np.array(highs, kind), k
        self.kth = np.array([-np.inf] * len(lows), kind)
        self.best: list[list[tuple]] = [[] for _ in lows]  # (score, -id), least first

    def reach(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The highest score that each box between least and most may add to a window; -inf: none."""
        top = np.minimum(most[:, None], self.high)
        gains = (most[:, None] >= self.low) & (least[:, None] <= self.high) & (top >= self.kth)
        return np.where(gains, top, -np.inf).max(1, initial=-np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = np.maximum(self.low, self.kth)
        fits = (scores >= least.min()) & (scores <= self.high.max())
        if not fits.any():
            return
        scores, ids = scores[fits], ids[fits]
        met = range(len(self.best)) if len(scores) > self.k else np.flatnonzero(((scores >= least[:, None]) & (scores <= self.high[:, None])).any(1))
        for w in met:
            own, best = (scores >= least[w]) & (scores <= self.high[w]), self.best[w]
            some, keys = scores[own], ids[own]
            if len(some) > self.k:  # no more than these and their ties can stay
                top = some >= np.sort(some)[-self.k]
                some, keys = some[top], keys[top]
            for score, key in zip(some, keys):
                entry = (int(score), -int(key))
                if len(best) < self.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == self.k:
                self.kth[w] = best[0][0]


class PackedTree:
    """An R-tree packed by sort-tile-recursive: the rows of each label are cut along one coordinate after the other, those of the
    largest variance first, into slabs of whole leaves; runs of leaves make the nodes above. A node has the least and greatest
    value of every coordinate and of the labels, so each coordinate's product with a query's lies in an interval, and their
    sums bound every inner product below the node."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        spread = np.argsort(-vectors.astype(float).var(0), kind="stable")
        leaves = [leaf for label in np.unique(labels) for leaf in tiles(vectors, np.flatnonzero(labels == label), spread)]
        order = np.concatenate(leaves)
        self.vectors, self.labels, self.ids = vectors[order], labels[order], ids[order]
        ends = np.cumsum([len(leaf) for leaf in leaves])
        self.levels = []
        begins = np.concatenate([[0], ends[:-1]])
        low, high = np.minimum.reduceat(self.vectors, begins), np.maximum.reduceat(self.vectors, begins)
        first, last = self.labels[begins], self.labels[begins]
        self.levels.append((begins, ends, low, high, first, last))
        while len(low) > 1:
            begins = np.arange(0, len(low), FAN)
            ends = np.append(begins[1:], len(low))
            low, high = np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)
            first, last = np.minimum.reduceat(first, begins), np.maximum.reduceat(last, begins)
            self.levels.append((begins, ends, low, high, first, last))
        self.visited = self.seen = 0

    def search(self, query: np.ndarray, key: int, label: int, same: bool, windows: Windows) -> None:
        """Fills the windows with rows other than `key` whose label is (same) or isn't (not same) the given one."""
        plus, minus = np.where(query > 0, query, 0), np.where(query < 0, query, 0)
        queue: list[tuple] = []

        def offer(level: int, a: int, b: int) -> None:
            _, _, low, high, first, last = self.levels[level]
            fits = (first[a:b] <= label) & (last[a:b] >= label) if same else (first[a:b] != label) | (last[a:b] != label)
            least, most = low[a:b] @ plus + high[a:b] @ minus, high[a:b] @ plus + low[a:b] @ minus
            tops = windows.reach(least, most)
            for i in np.flatnonzero(fits & (tops > -np.inf)):
                heapq.heappush(queue, (-tops[i], level, a + int(i), least[i], most[i]))

        offer(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            _, level, at, least, most = heapq.heappop(queue)
            if windows.reach(np.array([least]), np.array([most]))[0] == -np.inf:  # the kth may have risen since
                continue
            a, b = self.levels[level][0][at], self.levels[level][1][at]
            if level:
                offer(level - 1, a, b)
                continue
            self.visited += b - a
            other = np.flatnonzero(self.ids[a:b] != key)
            windows.add((self.vectors[a:b] @ query)[other], self.ids[a:b][other])
        self.seen += len(self.ids)


def tiles(vectors: np.ndarray, rows: np.ndarray, dims: np.ndarray) -> Iterator[np.ndarray]:
    """rows in leaves of at most LEAF."""
    leaves = -(-len(rows) // LEAF)
    if leaves <= 1:
        yield rows
        return
    slabs = max(2, int(np.ceil(leaves ** (1 / max(1, len(dims)))))) if len(dims) > 1 else leaves
    rows = rows[np.argsort(vectors[rows, dims[0]], kind="stable")]
    size = -(-leaves // slabs) * LEAF
    for a in range(0, len(rows), size):
        yield from tiles(vectors, rows[a : a + size], dims[1:] if len(dims) > 1 else dims)


def exact(x: np.ndarray) -> np.ndarray:
    """As doubles where sums of products are exact in them, else as Python's integers."""
    return whole(x) if np.abs(x).max(initial=0) >= 1 << 20 or x.shape[1] >= 1 << 12 else x


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(scale * x). An anchor's positives are its highest rows of the same label; the
    negatives of a positive are the highest rows of other labels whose score is at least `low` and at most `high` percent of
    the positive's (a negative positive_score leaves none, as then the window is empty). Ties go to the smaller id.

    Vectors are dealt over shards of a fixed size whatever their labels, so a label with a third of all rows is many shards;
    each has a tree, anchors stream past every shard, a shard returns its best, and the best of all shards are kept. A box is
    left only if no window can gain from it, so the answer is exact, and there is no limit to what is visited.

    Rows whose label or vector is null, or whose vector is empty or holds null or non-finite components, take no part on either
    side, nor do rows without a key; vectors of different lengths don't meet. A row isn't its own positive or negative, nor are
    rows with its key. Of anchors that share a key the one with the least vector counts; repeated rows are found each. Scores
    beyond 64 bits become the nearest long. Anchors without positives, and positives without negatives, have no rows; extra
    columns are ignored; an empty table gives none.
    """

    def table(df: DataFrame) -> DataFrame:
        named = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label")).where("label is not null")
        return floors(usable(named, "k", "v", True, "label"), scale)

    rows, asked = table(vectors), one_a_key(table(anchors), "label")

    def tree(own: pd.DataFrame) -> PackedTree:
        return PackedTree(exact(np.stack(own["vector"].to_numpy())), own["label"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64))

    def queries(own: PackedTree, block: pd.DataFrame) -> np.ndarray:
        q = np.stack(block["vector"].to_numpy())
        return whole(q) if own.vectors.dtype == object or exact(q).dtype == object else q

    def nearest(own: PackedTree, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, a, its in zip(queries(own, block), block["vec_id"], block["label"]):
            best = Windows([-np.inf], [np.inf], positives, own.vectors.dtype.type)
            own.search(q, a, its, True, best)
            out += [(a, -i, s) for s, i in best.best[0]]
        return framed(out, ["vec_id", "positive_id", "positive_score"])

    found = meet(rows, asked, nearest, "vec_id long, positive_id long, positive_score long", prepare=tree)
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = checkpointed(found.withColumn("place", place).where(F.col("place") <= positives))
    wanted = found.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("wanted"))  # at most `positives`
    asked = asked.join(wanted, "vec_id").select(*asked.columns, F.col("wanted.place").alias("places"), F.col("wanted.positive_score").alias("scores"))

    def between(own: PackedTree, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, a, its, places, scores in zip(queries(own, block), block["vec_id"], block["label"], block["places"], block["scores"]):
            windows = Windows([-(-low * int(s) // 100) for s in scores], [high * int(s) // 100 for s in scores], negatives, own.vectors.dtype.type)
            own.search(q, a, its, False, windows)
            out += [(a, p, -i, s) for p, best in zip(places, windows.best) for s, i in best]
        return framed(out, ["vec_id", "place", "negative_id", "negative_score"])

    hard = meet(rows, asked, between, "vec_id long, place int, negative_id long, negative_score long", prepare=tree)
    rank = F.row_number().over(Window.partitionBy("vec_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hard.join(found, ["vec_id", "place"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Whole numbers as a frame of 64 bits; scores beyond them become the nearest."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({n: longs(np.array(c, object)) for n, c in zip(names, columns)})
