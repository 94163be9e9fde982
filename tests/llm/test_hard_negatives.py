import numpy as np
import pytest

from cohortspark.llm import hard_negatives
from cohortspark.llm.hard_negatives import PackedTree, Windows, exact

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, positive_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], SCHEMA)


def brute(rows, k=5, n=3):
    """anchor, positive, rank, negative, scores in whole numbers; rows of one length only meet."""
    use = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(np.float32(v)).all()]
    anchors = {}
    for i, v, label in use:
        if i % 50 == 0 and (i not in anchors or v < anchors[i][0]):
            anchors[i] = (v, label)
    out = []
    for a, (q, its) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, label) for i, v, label in use if i != a and len(v) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == its)[:k]:
            fit = sorted((t, i) for t, i, label in scored if label != its and 50 * -s <= 100 * -t <= 95 * -s)[:n]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def mined(df):
    found = hard_negatives.mine(df, df.where("vec_id % 50 = 0"))
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    centers = r.normal(size=(5, 12))
    out = [(i, (centers[i % 5] + r.normal(size=12) * 0.8).astype("f4").tolist(), int(r.integers(0, 4)) if i % 3 else 0) for i in range(900)]
    ties = [(1000 + i, np.round(r.normal(size=12)).tolist(), i % 3) for i in range(120)]
    odd = [(2000, None, 1), (2050, [None] * 12, 1), (2051, [float("nan")] * 12, 1), (2052, [float("inf")] * 12, 2), (2100, [0.0] * 12, 1), (2101, [], 1), (None, [1.0] * 12, 1), (2150, [1.0, 2.0], 1), (2151, [2.0, 1.0], 1), (2152, [1.0, 1.0], 2), (2200, [1.0] * 12, None)]
    copies = [(3000, out[3][1], 0)] * 3 + [(3001, out[3][1], 1)] * 4
    return out + ties + odd + copies


def test_mine(spark, rows):
    assert mined(table(spark, rows)) == brute(rows)


def test_many_shards(spark, rows, monkeypatch):
    from cohortspark.llm import vectors

    real = vectors.meet
    monkeypatch.setattr(hard_negatives, "meet", lambda *a, **k: real(*a, shard_rows=100, block_queries=3, **k))
    assert mined(table(spark, rows)) == brute(rows)


def test_large_components(spark):
    rows = [(0, [3e6, -2e6], 1), (1, [2.9e6, -2e6], 1), (2, [1.7e6, -1e6], 2), (3, [2e6, -2e6], 2), (4, [3e6, -1e6], 3), (50, [1.0, 5.0], 2)]
    assert mined(table(spark, rows)) == brute(rows)


def test_few_and_empty(spark):
    for rows in [], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.6, 0.0], 2)]:
        assert mined(table(spark, rows)) == brute(rows)


def test_boxes_are_left():
    """Of well parted groups only what may hold the best is visited, and nothing is missed."""
    r = np.random.default_rng(5)
    x = np.floor(256 * (r.normal(size=(40, 3))[np.repeat(np.arange(40), 200)] * 4 + r.normal(size=(8000, 3)) * 0.05))
    labels, ids = r.integers(0, 3, 8000), np.arange(8000)
    tree = PackedTree(exact(x), labels, ids)
    assert all(len(np.unique(tree.labels[a:b])) == 1 for a, b in zip(*tree.levels[0][:2]))
    for q in range(0, 8000, 400):
        w = Windows([-np.inf], [np.inf], 5)
        tree.search(x[q], q, labels[q], True, w)
        want = sorted(((int(x[q] @ x[i]), -i) for i in np.flatnonzero(labels == labels[q]) if i != q), reverse=True)[:5]
        assert sorted(w.best[0], reverse=True) == want
    assert tree.visited / tree.seen < 0.25
