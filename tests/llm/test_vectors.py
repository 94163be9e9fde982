import numpy as np
import pytest

from cohortspark.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, dim string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    centers = r.normal(size=(6, 24))
    v = [(i, (centers[i % 6] + r.normal(size=24) * 0.6).astype("f4").tolist()) for i in range(1500)]
    v += [(2000, v[3][1]), (2001, v[3][1]), (2050, v[3][1])]
    odd = [(3000, None), (3050, [None] + [1.0] * 23), (3051, [float("nan")] * 24), (3052, [float("inf")] * 24), (3100, [0.0] * 24), (3101, []), (None, [1.0] * 24), (3150, [1.0, 2.0]), (3151, [2.0, 1.0])]
    return v + odd


def best(pairs, k):
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:k]


def test_nearest(spark, rows):
    df = table(spark, rows)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    assert set(got) == {i for i in x if i % 50 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        want = best([(i, cosine(x[q], v)) for i, v in x.items() if i != q and len(v) == len(x[q])], 5)
        assert [f[0] for f in found] == list(range(1, len(want) + 1))
        for _, i, s in found:
            assert abs(s - cosine(x[q], x[i])) < 1e-12
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for i, _ in want} & {f[1] for f in found})
        total += len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_top_inner_products(spark, rows, lists):
    df = table(spark, rows)
    got = {}
    for r in topk.top_inner_products(df, df.where("vec_id % 50 = 0"), 5, n_lists=lists).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    assert set(got) == {i for i in x if i % 50 == 0}
    for q, found in got.items():
        want = best([(i, sum(a * b for a, b in zip(x[q], v))) for i, v in x.items() if i != q and len(v) == len(x[q])], 5)
        assert sorted(found) == [(k + 1, i, s) for k, (i, s) in enumerate(want)]


def test_large_components_and_few_rows(spark):
    df = table(spark, [(0, [3e8, -2e8]), (50, [1.0, 5.0]), (51, [2e8, 7.0]), (51, [2e8, 7.0])])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(df, df.where("vec_id % 50 = 0"), 5).collect())
    f = lambda v: [int(np.floor(256 * float(np.float32(c)))) for c in v]
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(f(a), f(b)))))
    one, two, three = [3e8, -2e8], [1.0, 5.0], [2e8, 7.0]
    assert [g[2:] for g in got if g[0] == 0] == [(51, dot(one, three)), (51, dot(one, three)), (50, dot(one, two))]
    assert [g[2:] for g in got if g[0] == 50] == [(51, dot(two, three)), (51, dot(two, three)), (0, dot(two, one))]


def test_empty(spark):
    df = table(spark, [])
    assert ann.nearest(df, df, 5).count() == 0
    assert topk.top_inner_products(df, df, 5).count() == 0
    one = table(spark, [(50, [1.0, 2.0])])
    assert ann.nearest(one, one, 5).count() == 0 and topk.top_inner_products(one, one, 5).count() == 0


def test_blocks_meet_all_shards(spark, rows):
    df = vectors.usable(table(spark, rows), "vec_id", "embedding", zeros=True)
    import pandas as pd

    met = vectors.meet(df, df.where("vec_id % 50 = 0"), lambda r, q: pd.DataFrame({"n": [len(r) * len(q)]}), "n long", 200, 7)
    a, b = df.where("dim = 24").count(), df.where("vec_id % 50 = 0 and dim = 24").count()
    assert sum(r.n for r in met.collect()) == a * b + 2


def test_recall_and_share_on_the_given_vectors(spark):
    """At least nine of ten of the nearest are found, from less than half of the vectors."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    own = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in own]), np.stack([v for _, v in own])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.flatnonzero(ids % 50 == 0)
    cosines = unit[asked] @ unit.T
    cosines[np.arange(len(asked)), asked] = -2
    want = {int(ids[q]): set(ids[np.lexsort((ids, -cosines[k]))[:5]].tolist()) for k, q in enumerate(asked)}
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(want[q] & got[q]) for q in want) / sum(map(len, want.values())) >= 0.9
    found = ann.CollisionIndex(x).search(x[asked], 5, [np.array([q]) for q in asked])
    assert np.mean([len(places) for places, _ in found]) / len(x) < 0.5
