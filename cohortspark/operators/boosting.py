"""Boosted trees of many settings and folds at once, from histograms of gradients."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_folder

#: Bins of a feature; rows of a leaf and second derivatives that a side of a split needs; trees between two written margins.
BINS, LEAF_ROWS, LEAF_HESSIAN, TREES_A_WRITE = 64, 20, 1e-3, 10
#: Cells of a block; sums that a task may hold, and those that travel as one array; cells times models times features that all
#: tasks may get.
BLOCK, CELLS, CELLS_A_TASK, AT_ONCE = 2048, 16_000_000, 200_000, 4_000_000
TRAIN, VALID, TEST = 0, 1, 2


@dataclass
class Model:
    """One setting over one set of roles. depth: levels of splits (0: no bound); leaves: the most of a tree."""

    roles: int
    depth: int
    rate: float
    leaves: int
    start: float = 0.0
    over: bool = False  # a tree without a split changes nothing, nor would the next


@dataclass
class Node:
    g: float
    h: float
    n: int
    level: int
    known: bool = False
    split: tuple | None = None  # gain, feature, bin, and the left side's g, h, n
    left: int = -1


@dataclass
class Growth:
    """A tree that grows best leaf first. Splits are tried ahead of their turn, so that one pass over the rows serves a whole level
    of every tree; `grown` then takes them in the order of their gains, up to the bound of leaves."""

    model: Model
    nodes: list[Node] = field(default_factory=lambda: [Node(0.0, 0.0, 0, 0)])
    chosen: list[int] = field(default_factory=list)

    def open(self, i: int) -> bool:
        node = self.nodes[i]
        return not node.known and not (self.model.depth and node.level >= self.model.depth) and (i == 0 or node.n >= 2 * LEAF_ROWS)

    def grown(self) -> list[int]:
        """The nodes whose histograms are needed next; none once the tree stands in `chosen`."""
        if self.open(0):
            return [0]
        queue = [(-self.nodes[0].split[0], 0)] if self.nodes[0].split else []
        self.chosen = []
        while queue and len(self.chosen) + 1 < self.model.leaves:
            at = self.nodes[heapq.heappop(queue)[1]]
            rest = self.model.leaves - 2 - len(self.chosen)  # splits after this one
            if at.left < 0:
                # no leaf beyond the first `rest` of those waiting can have its turn
                ahead = [self.nodes[i] for _, i in heapq.nsmallest(rest, queue)]
                new = [c for x in [at, *ahead] if x.left < 0 for c in self.parted(x)]
                needed = [c for c in new if self.open(c)] if rest else []
                if needed:
                    return needed
            self.chosen.append(at.left)
            for c in (at.left, at.left + 1):
                if self.nodes[c].split:
                    heapq.heappush(queue, (-self.nodes[c].split[0], c))
        return []

    def parted(self, node: Node) -> tuple[int, int]:
        _, _, _, g, h, n = node.split
        node.left = len(self.nodes)
        self.nodes += [Node(g, h, n, node.level + 1), Node(node.g - g, node.h - h, node.n - n, node.level + 1)]
        return node.left, node.left + 1


@dataclass
class Trees:
    """A tree of every model as arrays (model, node): feature (-1: a leaf), bin, left child (the right one follows), value."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    levels: int

    @classmethod
    def of(cls, grown: list[Growth], final: bool) -> Trees:
        """Of all tried splits, or (final) of the chosen ones with their leaves' values."""
        size = max(len(t.nodes) for t in grown)
        shape = (len(grown), size)
        out = cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape), 0)
        for m, t in enumerate(grown):
            chosen = set(t.chosen)
            for i, x in enumerate(t.nodes):
                if x.left >= 0 and (not final or x.left in chosen):
                    out.feature[m, i], out.bin[m, i], out.left[m, i] = x.split[1], x.split[2], x.left
                    out.levels = max(out.levels, x.level + 1)
                elif final and chosen:
                    out.value[m, i] = -x.g / x.h * t.model.rate if x.h > 0 else 0.0
        return out

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """(model, row): the node where each row ends. bins: (feature, row)."""
        m, r = np.arange(len(self.feature))[:, None], np.arange(bins.shape[1])[None, :]
        at = np.zeros((len(self.feature), bins.shape[1]), np.int32)
        for _ in range(self.levels):
            f = self.feature[m, at]
            at = np.where(f >= 0, self.left[m, at] + (bins[f, r] > self.bin[m, at]), at)
        return at

    def added(self, bins: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.value))[:, None], self.leaf(bins)]

    def some(self, models: np.ndarray) -> Trees:
        return Trees(self.feature[models], self.bin[models], self.left[models], self.value[models], self.levels)


def binned(df: DataFrame, features: str) -> tuple[DataFrame, int]:
    """df with _bins, a byte for each component of an array column, and how many there are: bins end at quantiles of all rows
    (within 1/10,000 of the rows), of which there are at most BINS - 1 a component. Null and NaN are in the last bin."""
    each = df.select(F.posexplode(features).alias("f", "x")).where("x is not null and not isnan(x)")
    cuts = [i / BINS for i in range(1, BINS)]
    found = {r.f: sorted(set(r.q)) for r in each.groupBy("f").agg(F.percentile_approx("x", cuts, 10_000).alias("q")).collect()}
    width = max(found, default=-1) + 1
    edges = [np.array(found.get(f, []), float) for f in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array([[np.nan if v is None else v for v in row] for row in batch[features]], float).reshape(len(batch), -1)
                last = np.array([len(e) for e in edges])
                b = np.stack([np.where(np.isnan(x[:, f]), last[f], np.searchsorted(e, x[:, f], "left")) for f, e in enumerate(edges)], 1).astype(np.uint8)
                yield batch.drop(columns=[features]).assign(_bins=[r.tobytes() for r in b])

    rest = [f for f in df.schema if f.name != features]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", _bins binary"
    return df.mapInPandas(run, schema), width


@dataclass
class Rows:
    """A block of cells, which are all rows with the same bins: bins (feature, cell), rows that train and their labels' sum (set,
    cell), margins (model, cell)."""

    bins: np.ndarray
    n: np.ndarray
    positive: np.ndarray
    margins: np.ndarray


def cells(rows: DataFrame, n_sets: int) -> DataFrame:
    """(_bins, n, positive: an array with a number for each set) of rows (label, _bins, _roles). Trees can't part rows with the
    same bins, so sums over them are all that training needs, however many rows there are."""
    trains = [F.substring("_roles", s + 1, 1) == F.lit(bytes([TRAIN])) for s in range(n_sets)]
    sums = [F.sum(F.when(t, x).otherwise(F.lit(0.0))) for x in (F.lit(1.0), F.col("label")) for t in trains]
    names = [f"_{i}" for i in range(2 * n_sets)]
    each = rows.groupBy("_bins").agg(*(c.alias(x) for c, x in zip(sums, names)))
    return each.select("_bins", F.array(*names[:n_sets]).alias("n"), F.array(*names[n_sets:]).alias("positive"))


def block(some: list[Row], width: int, n_models: int) -> Rows:
    bins = np.frombuffer(b"".join(bytes(r[0]) for r in some), np.uint8).reshape(len(some), width).T
    n, positive = (np.array([r[k] for r in some], float).T for k in (1, 2))
    return Rows(bins.copy(), n, positive, np.zeros((n_models, len(some))))


def totals(part: Iterator[Rows]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in part:
        yield b.n.sum(1), b.positive.sum(1)


def started(models: list[Model], n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The models' first margins, the logit of their train rows' share; those without such rows are over."""
    share = np.clip(positive / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    for m in models:
        m.over = bool(n[m.roles] == 0)
    return np.array([0.0 if m.over else np.log(share[m.roles] / (1 - share[m.roles])) for m in models])


def tree_of_each(models: list[Model], best: Callable[[Trees, list[tuple[int, int]]], Iterable[tuple]]) -> Trees:
    """The next tree of every model. best: as in `best_splits`, over all rows."""
    grown = [Growth(m) for m in models]
    while needed := [(m, i) for m, t in enumerate(grown) if not models[m].over for i in t.grown()]:
        for m, i, (g, h, rows_in), split in best(Trees.of(grown, final=False), needed):
            node = grown[m].nodes[i]
            if i == 0:
                node.g, node.h, node.n = g, h, int(rows_in)
            node.split = split
        for m, i in needed:
            grown[m].nodes[i].known = True
    for m, t in zip(models, grown):
        m.over = m.over or not t.chosen
    return Trees.of(grown, final=True)


def boost(rows: DataFrame, width: int, models: list[Model], rounds: int) -> RDD:
    """Rows with what all models' trees add up to, from rows (label 0/1, _bins, _roles: a byte for each set of roles). They train a
    model where their role in its set is TRAIN.

    Rows are summed up to cells first. Up to AT_ONCE cells times models (so few features, of however many rows) the sums go to all
    tasks and the models are dealt over these; beyond, cells are dealt over tasks, which take every pass of all models together.
    """
    context = rows.sparkSession.sparkContext
    sums, most = cells(rows, max(m.roles for m in models) + 1), AT_ONCE // (len(models) * max(1, width))
    some = sums.limit(most + 1).collect()
    if len(some) > most:
        return boost_together(sums, width, models, rounds)
    if not some:
        return context.emptyRDD()
    told = context.broadcast(block(some, width, 0))
    tasks = min(len(models), 3 * context.defaultParallelism)
    deal = [list(range(t, len(models), tasks)) for t in range(tasks)]

    def run(own: list[int]) -> list[tuple[int, np.ndarray]]:
        return list(zip(own, boost_alone(told.value, [models[m] for m in own], rounds)))

    margins = dict(context.parallelize(deal, tasks).flatMap(run).collect())
    told.unpersist()
    whole = replace(block(some, width, 0), margins=np.array([margins[m] for m in range(len(models))]))
    return context.parallelize([Rows(*(x[:, i : i + BLOCK] for x in (whole.bins, whole.n, whole.positive, whole.margins))) for i in range(0, len(some), BLOCK)], -(-len(some) // BLOCK))


def boost_alone(b: Rows, models: list[Model], rounds: int) -> np.ndarray:
    """The margins (model, cell) of some models over all cells."""
    models, sets = [replace(m) for m in models], np.array([m.roles for m in models])
    b = replace(b, margins=np.repeat(started(models, *next(totals(iter([b]))))[:, None], b.bins.shape[1], 1))
    for _ in range(rounds):
        trees = tree_of_each(models, lambda tried, needed: best_of(needed, [(0, histograms(b, sets, tried, needed))]))
        b.margins += trees.added(b.bins)
        if all(m.over for m in models):
            break
    return b.margins


def boost_together(sums: DataFrame, width: int, models: list[Model], rounds: int) -> RDD:
    """The same for any number of cells.

    A pass is one job for all models: tasks add up gradients by (model and node, feature, bin), the sums meet in a shuffle by
    node, and only each node's best split comes to the driver. So jobs grow with rounds and levels, not with models or rows
    (beyond CELLS sums a task, nodes take turns). Blocks of cells stay where they are, as an RDD: what a pass does to them is a
    few array operations, and planning a query for each would cost more than the pass. Every TREES_A_WRITE rounds margins are
    checkpointed, so a lost executor's blocks are made anew from there.
    """
    context = sums.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(sums.sparkSession))
    sets = np.array([m.roles for m in models])

    def blocks(part: Iterator[Row]) -> Iterator[Rows]:
        while some := list(itertools.islice(part, BLOCK)):
            yield block(some, width, len(models))

    state, kept = sums.rdd.mapPartitions(blocks).persist(), []
    n, positive = state.mapPartitions(totals).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    start = started(models, n, positive)
    state = state.map(lambda b: replace(b, margins=b.margins + start[:, None])).persist()
    at_once = max(1, CELLS // (3 * BINS * width))
    for done in range(1, rounds + 1):
        trees = tree_of_each(models, lambda tried, needed: [x for k in range(0, len(needed), at_once) for x in best_splits(state, width, sets, tried, needed[k : k + at_once])])
        old = state
        state = old.map(lambda b, trees=trees: replace(b, margins=b.margins + trees.added(b.bins))).persist()
        if done % TREES_A_WRITE == 0:
            state.checkpoint()
            state.count()
            for r in kept:
                r.unpersist()
            kept = []
            old.unpersist()
        else:
            kept.append(old)
        if all(m.over for m in models):
            break
    return state


def histograms(b: Rows, sets: np.ndarray, tried: Trees, needed: list[tuple[int, int]]) -> np.ndarray:
    """Sums of the first and second derivatives and of rows: (needed (model, node), feature, 3, bin)."""
    slots = np.full(tried.feature.shape, -1, np.int64)
    for k, (m, i) in enumerate(needed):
        slots[m, i] = k
    used = np.unique([m for m, _ in needed])
    slot = slots[used][np.arange(len(used))[:, None], tried.some(used).leaf(b.bins)]
    n = b.n[sets[used]]
    m, r = np.nonzero((slot >= 0) & (n > 0))
    slot, n, p = slot[m, r] * BINS, n[m, r], 1 / (1 + np.exp(-b.margins[used[m], r]))
    g, h = n * p - b.positive[sets[used[m]], r], n * p * (1 - p)
    total = np.empty((len(needed), len(b.bins), 3, BINS))
    for f, bins in enumerate(b.bins):
        key = slot + bins[r]
        for k, w in enumerate((g, h, n)):
            total[:, f, k] = np.bincount(key, w, len(needed) * BINS).reshape(-1, BINS)
    return total


def best_of(needed: list[tuple[int, int]], parts: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple]:
    """(model, node, (g, h, n), best split or None) of each of the needed (model, node) that has rows, from the sums of a few."""
    for k, total in parts:
        whole, left = total.sum(3), total.cumsum(3)
        right = whole[..., None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, :, 0] ** 2 / left[:, :, 1] + right[:, :, 0] ** 2 / right[:, :, 1] - (whole[:, :, 0] ** 2 / whole[:, :, 1])[..., None]
        fits = (left[:, :, 2] >= LEAF_ROWS) & (right[:, :, 2] >= LEAF_ROWS) & (left[:, :, 1] >= LEAF_HESSIAN) & (right[:, :, 1] >= LEAF_HESSIAN)
        gain = np.where(fits, np.round(gain, 9), 0).reshape(len(total), -1)  # of equal gains the first feature and bin
        at = gain.argmax(1)
        for j in np.flatnonzero(whole[:, 0, 2] > 0):
            f, b = divmod(int(at[j]), BINS)
            split = (float(gain[j, at[j]]), f, b, *(float(x) for x in left[j, f, :, b])) if gain[j, at[j]] > 0 else None
            yield *needed[k + int(j)], tuple(map(float, whole[j, 0])), split


def best_splits(state: RDD, width: int, sets: np.ndarray, tried: Trees, needed: list[tuple[int, int]]) -> list[tuple]:
    """`best_of` the needed (model, node) over all blocks."""
    group = max(1, CELLS_A_TASK // (3 * BINS * width))  # nodes whose sums travel as one array

    def sums(part: Iterator[Rows]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for b in part:
            own = histograms(b, sets, tried, needed)
            total = own if total is None else total + own
        if total is not None:
            for k in range(0, len(needed), group):
                yield k, total[k : k + group]

    tasks = max(1, min(state.getNumPartitions(), -(-len(needed) // group)))
    return state.mapPartitions(sums).reduceByKey(lambda a, b: a + b, tasks).mapPartitions(lambda part: best_of(needed, part)).collect()


def probabilities(state: RDD, spark: SparkSession) -> DataFrame:
    """(_bins, probs): what each model says of the rows with these bins."""

    def run(b: Rows) -> Iterator[tuple]:
        return zip((bytearray(x) for x in b.bins.T.copy()), (1 / (1 + np.exp(-b.margins))).T.tolist())

    return spark.createDataFrame(state.flatMap(run), "_bins binary, probs array<double>")
