"""Greedy links, fusions and regularisation paths against plain computations."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from cohortspark.operators import cohort as K
from cohortspark.operators import evaluate as E
from cohortspark.operators import logistic
from cohortspark.operators import models as M


def looped(reports, orders, most):
    """Reports in order, each taking the nearest free order: as pairs, so that a repeated report takes one."""
    pairs = [((t, r, (t - u).days, u, o), p) for r, p, t in reports for o, q, u in orders if p is not None and p == q and 0 <= (t - u).days <= most and r is not None and o is not None]
    done, taken, out = set(), set(), []
    for (_, r, delta, _, o), p in sorted(pairs, key=lambda x: x[0]):
        if (p, r) not in done and (p, o) not in taken:
            done.add((p, r))
            taken.add((p, o))
            out.append((r, o, delta))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_links(spark, seed):
    r = random.Random(seed)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(r.randint(0, 60))
    reports = [(r.choice([i, i, None]), r.choice([1, 1, 1, 2, None]), day()) for i in range(120)] + [(3, 1, day())]
    orders = [(i, r.choice([1, 1, 1, 2, None]), day()) for i in range(110)]
    a = spark.createDataFrame(reports, "report_id long, patient long, report_time date")
    b = spark.createDataFrame(orders, "order_id long, patient long, order_time date")
    got = sorted((x.report_id, x.order_id, x.delta_days) for x in K.link_greedy(a, b, 10).collect())
    assert got == looped(reports, orders, 10) and len(got) > 30
    assert K.link_greedy(a.limit(0), b).isEmpty() and K.link_greedy(a, b.limit(0)).isEmpty()


def newton(x, y, l2=0.0, steps=60):
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.append(np.full(x.shape[1] - 1, l2 * len(x)), 0.0)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - y) + pull * w)
    return w


def test_fusions_of_all_sets(spark):
    r = np.random.default_rng(3)
    n, models = 300, ["A", "B", "C"]
    rows, z, y = [], {}, {}
    for task in ("s", "t"):
        z[task] = r.normal(size=(n, 3))
        y[task] = (z[task][:, 0] + 0.5 * z[task][:, 1] + r.normal(size=n) > 0).astype(int)
        rows += [(m, task, i, int(y[task][i]), float(1 / (1 + np.exp(-z[task][i, k])))) for i in range(n) for k, m in enumerate(models)]
    df = spark.createDataFrame(rows, "model string, task string, patient_id long, label int, prob double")
    got = {(x.task, x.model, x.patient_id): x.prob for x in E.fuse_subsets(df.where("patient_id < 200"), df.where("patient_id >= 200"), models).collect()}
    assert len(got) == 2 * 4 * 100
    for task in ("s", "t"):
        for k in (2, 3):
            for chosen in itertools.combinations(range(3), k):
                w = newton(z[task][:200][:, chosen], y[task][:200])
                want = 1 / (1 + np.exp(-(z[task][200:][:, chosen] @ w[:-1] + w[-1])))
                name = "+".join(models[i] for i in chosen)
                assert np.allclose([got[task, name, i] for i in range(200, 300)], want, atol=1e-6)


def test_parted_classes_have_equal_weights(spark):
    rows = [(m, "t", i, int(i >= 10), (0.9 if i >= 10 else 0.1) + k * 0.01) for i in range(20) for k, m in enumerate("AB")]
    df = spark.createDataFrame(rows, "model string, task string, patient_id long, label int, prob double")
    got = {x.patient_id: x.prob for x in E.fuse_subsets(df, df, ["A", "B"]).collect()}
    logit = lambda p: np.log(p / (1 - p))
    for i, p in got.items():
        q = 0.9 if i >= 10 else 0.1
        assert p == pytest.approx(1 / (1 + np.exp(-(logit(q) + logit(q + 0.01)) / 2)))


def test_path(spark):
    r = np.random.default_rng(4)
    x = np.column_stack([r.normal(size=400) * 3 + 50, r.normal(size=400) * 0.01, np.ones(400), r.normal(size=400)])
    y = (x[:, 3] + (x[:, 0] - 50) / 3 + r.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(list(map(float, v)), int(c)) for v, c in zip(x, y)] + [([0.0] * 4, None)], "x array<double>, label int").repartition(5)
    df = df.select("label", array_to_vector("x").alias("features"))
    strengths = [10.0, 0.1, 1e-3, 1e-5]
    got = logistic.path(df, strengths)
    for s, w in zip(strengths, got):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        gradient = np.append(x.T @ (p - y) / 400 + s * w[:-1], (p - y).mean())
        assert np.abs(gradient).max() < 1e-6
        assert np.allclose(w[[0, 1, 3]], newton(x[:, [0, 1, 3]], y, s)[:3], atol=1e-5)


def test_passes_are_shared(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(r.normal(size=3).tolist(), int(r.random() < 0.4), ["train", "valid", "test"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label int, split string").select("label", "split", array_to_vector("x").alias("features"))
    real, calls = logistic.summed, []
    monkeypatch.setattr(logistic, "summed", lambda *a: calls.append(1) or real(*a))
    out, strength, score = M.linear_probe(df)
    assert len(calls) < 60 and strength in M.STRENGTHS and 0 <= score <= 1 and out.columns == ["label", "split", "features", "prob"]
    assert out.count() == 300
    none, _, score = M.linear_probe(df.withColumn("split", M.F.lit("test")))
    assert {x.prob for x in none.collect()} == {0.5} and score != score
