"""Batched trees against a plain loop over one model, and what a search over many must keep."""

import numpy as np
import pytest

from cohortspark.operators import boosting as B
from cohortspark.operators import models as M
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F


def grown(bins, y, depth, rate, leaves, rounds):
    """Margins of every row: one tree after the other, the leaf of the largest gain first, splits found by trying all."""
    p0 = min(max(y.mean(), 1e-9), 1 - 1e-9)
    margin = np.full(len(y), np.log(p0 / (1 - p0)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def split(rows, level):
            best = (0.0, None)
            if len(rows) < 2 * B.LEAF_ROWS or (depth and level >= depth):
                return best
            for f in range(bins.shape[1]):
                for b in range(B.BINS):
                    left = bins[rows, f] <= b
                    i, j = rows[left], rows[~left]
                    if min(len(i), len(j)) < B.LEAF_ROWS or min(h[i].sum(), h[j].sum()) < B.LEAF_HESSIAN:
                        continue
                    gain = round(g[i].sum() ** 2 / h[i].sum() + g[j].sum() ** 2 / h[j].sum() - g[rows].sum() ** 2 / h[rows].sum(), 9)
                    if gain > best[0]:
                        best = (gain, (i, j))
            return best

        parts = [(np.arange(len(y)), 0)]
        found = [split(*parts[0])]
        while len(parts) < leaves:
            k = max(range(len(parts)), key=lambda k: (found[k][0], -k))
            if found[k][1] is None:
                break
            level = parts[k][1] + 1
            new = [(i, level) for i in found[k][1]]
            parts[k : k + 1], found[k : k + 1] = new, [split(*x) for x in new]
        if len(parts) == 1:
            break
        for i, _ in parts:
            margin[i] -= rate * g[i].sum() / h[i].sum()
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(420, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=420) * 0.5 > 0).astype(int)
    rows = [(i, [*map(float, v)], int(c), "train" if i % 3 else "valid" if i % 2 else "test") for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "patient_id long, x array<double>, label int, split string")
    return df.select("patient_id", "label", "split", array_to_vector("x").alias("features")), x, y


POINTS = [{"depth": 0, "rate": 0.5, "leaves": 5}, {"depth": 2, "rate": 0.1, "leaves": 10}, {"depth": 3, "rate": 0.5, "leaves": 2}, {"depth": 0, "rate": 0.1, "leaves": 100}]


@pytest.mark.parametrize("point", POINTS, ids=str)
def test_one_model(spark, table, point):
    df, x, y = table
    got = {r.patient_id: r.prob for r in M.train_trees(df, [point], rounds=4)[0].collect()}
    flat = df.repartition(3).withColumn("x", M.vector_to_array("features")).drop("features")
    train = np.array([i for i in range(len(y)) if i % 3])
    bins, width = B.binned(flat.select("patient_id", "x"), "x")
    b = {r.patient_id: list(r._bins) for r in bins.collect()}
    assert width == 3 and all(max(v) < B.BINS for v in b.values())
    want = grown(np.array([b[i] for i in train]), y[train].astype(float), **point, rounds=4)
    assert np.allclose([got[i] for i in train], want, atol=1e-9)


def test_models_are_independent(spark, table):
    """All points together, in passes that share rows, give what each gives alone, also where few sums fit in a task."""
    df, _, _ = table
    alone = [M.train_trees(df, [p], rounds=3) for p in POINTS]
    best = max(range(len(POINTS)), key=lambda k: (alone[k][2], -k))
    cells = B.CELLS
    B.CELLS = 3 * B.BINS * 3 * 2
    try:
        found, point, score = M.train_trees(df, POINTS, rounds=3)
    finally:
        B.CELLS = cells
    assert point == POINTS[best] and score == pytest.approx(alone[best][2])
    want = {r.patient_id: r.prob for r in alone[best][0].collect()}
    assert {r.patient_id: r.prob for r in found.collect()} == pytest.approx(want)


def test_folds(spark, table):
    df, _, _ = table
    out = M.train_trees_cv(df, "patient_id", 3, POINTS[:2], rounds=2)
    assert out.count() == df.count() == out.select("patient_id").distinct().count()
    # a fold's predictions are those of a model that saw neither its rows nor the next fold's
    fold = {r.patient_id: r.fold for r in out.collect()}
    one = df.withColumn("split", F.udf(lambda i: "test" if fold[i] == 1 else "valid" if fold[i] == 2 else "train")("patient_id"))
    want = {r.patient_id: r.prob for r in M.train_trees(one, POINTS[:2], rounds=2)[0].where("split = 'test'").collect()}
    assert {r.patient_id: r.prob for r in out.where("fold = 1").collect()} == pytest.approx(want)


def test_leaves_are_bounded():
    class Full(B.Growth):
        pass

    t = Full(B.Model(0, 0, 0.1, 6))
    r = np.random.default_rng(0)
    passes = 0
    while needed := t.grown():
        passes += 1
        for i in needed:
            node = t.nodes[i]
            if i == 0:
                node.n = 10_000
            node.known, node.split = True, (float(r.random()), 0, 1, 0.0, 1.0, node.n // 2)
    assert len(t.chosen) == 5 and passes <= 5
    # the chosen ones are the best leaf at each turn
    leaves, taken = {0}, []
    for left in t.chosen:
        best = max(leaves, key=lambda i: t.nodes[i].split[0])
        assert t.nodes[best].left == left
        leaves = leaves - {best} | {left, left + 1}
        leaves = {i for i in leaves if t.nodes[i].split} or leaves
        taken.append(best)


def test_odd_rows(spark):
    rows = [(i, [float(i % 7), None if i % 5 == 0 else float("nan") if i % 11 == 0 else 1.0], None if i % 13 == 0 else int(i % 7 > 3), "train" if i % 4 else "valid") for i in range(300)]
    df = spark.createDataFrame(rows, "patient_id long, x array<double>, label int, split string")
    dense = df.select("patient_id", "label", "split", array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("features"))
    found, _, score = M.train_trees(dense, POINTS[:1], rounds=3)
    assert found.count() == 300 and found.where("prob is null or prob <= 0 or prob >= 1").isEmpty() and score > 0.99
    none, _, score = M.train_trees(dense.withColumn("split", F.lit("test")), POINTS[:1], rounds=3)
    assert {r.prob for r in none.collect()} == {0.5} and score != score
    assert M.train_trees(dense.limit(0), POINTS[:1], rounds=2)[0].count() == 0
    assert M.train_trees_cv(dense.limit(0), "patient_id", 3, POINTS[:1], rounds=2).count() == 0


def test_passes_do_not_grow_with_models(spark, table, monkeypatch):
    df, _, _ = table
    real, calls = B.best_splits, []
    monkeypatch.setattr(B, "best_splits", lambda *a: calls.append(1) or real(*a))
    M.train_trees(df, [POINTS[1]], rounds=2)
    one = len(calls)
    M.train_trees_cv(df, "patient_id", 4, [dict(POINTS[1], rate=x) for x in (0.1, 0.2, 0.3)], rounds=2)
    assert len(calls) - one <= one


def test_few_cells_need_no_pass(spark, table, monkeypatch):
    """Rows with the same bins are one cell; up to AT_ONCE of them no job is a pass, and beyond passes find the same."""
    df, _, _ = table
    df = df.unionByName(df)  # every cell has two rows at least
    with monkeypatch.context() as m:
        m.setattr(B, "best_splits", lambda *a: pytest.fail("a pass"))
        alone, point, score = M.train_trees(df, POINTS[:2], rounds=3)
        got = [(r.patient_id, r.prob) for r in alone.orderBy("patient_id").collect()]
    monkeypatch.setattr(B, "AT_ONCE", 0)
    together, point_, score_ = M.train_trees(df, POINTS[:2], rounds=3)
    want = [(r.patient_id, r.prob) for r in together.orderBy("patient_id").collect()]
    assert len(got) == 840 and [k for k, _ in got] == [k for k, _ in want] and np.allclose([p for _, p in got], [p for _, p in want], atol=1e-9)
    assert point == point_ and score == pytest.approx(score_)


def test_cells_hold_all_train_rows(spark):
    rows = spark.createDataFrame([(float(i % 2), bytearray([i % 3, 0]), bytearray([i % 2, 2])) for i in range(600)], "label double, _bins binary, _roles binary")
    got = {bytes(r._bins): (r.n, r.positive) for r in B.cells(rows, 2).collect()}
    assert got == {bytes([k, 0]): ([100.0, 0.0], [0.0, 0.0]) for k in range(3)}
