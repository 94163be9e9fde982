"""Logistic regressions of one table at many L2 strengths, fit in the same passes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows of a block, steps that a fit remembers, passes at most, and the largest part of a gradient at which a fit ends.
BLOCK, MEMORY, PASSES, CLOSE = 4096, 12, 400, 1e-9


def blocks(df: DataFrame) -> RDD:
    """(features with a last column of 1, label) of df (features: vector, label), in blocks of rows."""

    def run(part: Iterator[Row]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while some := list(itertools.islice(part, BLOCK)):
            x = np.array([r[0] for r in some], float).reshape(len(some), -1)
            yield np.hstack([x, np.ones((len(some), 1))]), np.array([r[1] for r in some], float)

    return df.where("label is not null").select(vector_to_array("features"), F.col("label").cast("double")).rdd.mapPartitions(run)


def summed(rdd: RDD, f) -> tuple | None:
    """The sum of f's arrays over all blocks, by a tree of tasks."""
    add = lambda a, b: b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))
    return rdd.map(f).treeAggregate(None, add, add)


@dataclass
class Fit:
    """One minimisation by limited-memory quasi-Newton steps, which asks for a value and gradient at `trial` and is told."""

    at: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    trial: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    memory: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.gradient is not None:
            slope = self.gradient @ self.way
            if not value <= self.value + 1e-4 * self.step * slope + 1e-15 * abs(self.value):
                self.step /= 2
                if self.step < 1e-12:
                    self.done = True  # no way down that numbers can tell
                self.trial = self.at + self.step * self.way
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
                self.memory = [*self.memory[1 - MEMORY :], (s, y)]
            self.at = self.trial
        self.value, self.gradient = value, gradient
        self.done = bool(np.abs(gradient).max() <= CLOSE)
        q, pairs = gradient.copy(), []
        for s, y in reversed(self.memory):
            a = s @ q / (s @ y)
            q -= a * y
            pairs.append((a, s, y))
        if self.memory:
            s, y = self.memory[-1]
            q *= s @ y / (y @ y)
        for a, s, y in reversed(pairs):
            q += s * (a - y @ q / (s @ y))
        self.way, self.step = -q, 1.0 if self.memory else min(1.0, 1 / max(np.abs(gradient).max(), 1e-12))
        self.trial = self.at + self.step * self.way


def path(df: DataFrame, strengths: list[float]) -> np.ndarray:
    """(strength, weights and intercept) of the regressions of label 0/1 on features that minimise the mean logistic loss plus
    strength / 2 times the sum of squared weights (the intercept is free); zeros without labelled rows.

    A pass is one job, in which every block gives all fits their losses and gradients, a few numbers a feature; so passes over
    the rows are as many as the slowest fit needs and not their sum. Features are centred and scaled for the search only.
    With strength 0 and classes that can be parted there is no minimum: what PASSES passes reach stands.
    """
    rdd = blocks(df).persist()
    sums = summed(rdd, lambda b: (b[0].sum(0), (b[0] ** 2).sum(0)))
    if sums is None:
        rdd.unpersist()
        return np.zeros((len(strengths), 0))
    n = sums[0][-1]
    mean = sums[0] / n
    sd = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    sd, mean = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0), np.append(mean[:-1], 0.0)
    sd[-1] = 1.0
    l2 = np.array(strengths)[:, None] * np.append(1 / sd[:-1] ** 2, 0.0)[None, :]
    fits = [Fit(np.zeros(len(sd))) for _ in strengths]
    for f in fits:
        f.trial = f.at
    for _ in range(PASSES):
        open_ = [k for k, f in enumerate(fits) if not f.done]
        if not open_:
            break
        w = np.stack([fits[k].trial for k in open_])

        def losses(b: tuple[np.ndarray, np.ndarray], w: np.ndarray = w) -> tuple[np.ndarray, np.ndarray]:
            x = (b[0] - mean) / sd
            z = x @ w.T
            loss = np.maximum(z, 0) - b[1][:, None] * z + np.log1p(np.exp(-np.abs(z)))
            return loss.sum(0), (1 / (1 + np.exp(-z)) - b[1][:, None]).T @ x

        loss, gradient = summed(rdd, losses)
        for j, k in enumerate(open_):
            fits[k].tell(loss[j] / n + (l2[k] * w[j] ** 2).sum() / 2, gradient[j] / n + l2[k] * w[j])
    rdd.unpersist()
    weights = np.stack([f.at for f in fits]) / sd
    weights[:, -1] -= weights[:, :-1] @ mean[:-1]
    return weights


def probabilities(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """df with probs, what each row of weights says, in order."""
    x = vector_to_array("features")
    said = []
    for w in weights:
        z = F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in w[:-1])), lambda a, b: a * b), F.lit(float(w[-1])), lambda t, v: t + v)
        said.append(1 / (1 + F.exp(-z)))
    return df.withColumn("probs", F.array(*said))
