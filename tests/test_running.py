"""Running sums in parts, exact quantiles and bootstrap intervals against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import evaluate as E
from cohortspark.operators import windows as W
from cohortspark.operators.running import cumulated, neighbours, quantiles, score_part, value_part
from cohortspark.operators.splits import drawn

SCORES = [0.0, 1e-13, 1e-9, 0.2, 0.2000001, 0.5, 0.5, 0.75, 1 - 1e-9, 1.0]


def test_parts_never_fall(spark):
    r = random.Random(1)
    scores = sorted([*SCORES, -3.0, 7.0, math.nan] + [r.random() ** r.choice([1, 9, 0.1]) for _ in range(3000)], key=lambda x: (x != x, x))
    values = sorted([0.0, -0.0, math.inf, -math.inf, math.nan, 1e300, -1e-300, *(r.gauss(0, 10 ** r.randint(-5, 12)) for _ in range(3000))], key=lambda x: (x != x, x))
    for part, data in ((score_part, scores), (value_part, values)):
        rows = spark.createDataFrame(list(enumerate(data)), "i int, x double").select("i", part(F.col("x")).alias("p")).orderBy("i").collect()
        got = [row.p for row in rows]
        assert None not in got and got == sorted(got) and len(set(got)) > 100


def test_sums_before(spark):
    r = random.Random(2)
    keys = {(r.choice(["a", None, "b"]), r.choice([r.random(), r.random() / 1e6, round(r.random(), 1)])) for _ in range(800)}
    data = [(g, k, r.randint(0, 5)) for g, k in keys]
    out = cumulated(spark.createDataFrame(data, "g string, k double, v long").repartition(5), ["g"], "k", ["v"], score_part(F.col("k"))).collect()
    assert len(out) == len(data)
    for row in out:
        mine = [(k, v) for g, k, v in data if g == row.g]
        assert row.v_before == sum(v for k, v in mine if k < row.k) and row.v_all == sum(v for _, v in mine)
    empty = spark.createDataFrame([], "g string, k double, v long")
    assert cumulated(empty, ["g"], "k", ["v"], score_part(F.col("k"))).isEmpty()


def test_quantiles(spark):
    r = random.Random(3)
    data = [(g, r.choice([None, r.gauss(0, 5), float(r.randint(1900, 1910))])) for g in ("a", "b", None) for _ in range(301)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    at = {"low": 0.025, "mid": 0.5, "high": 0.75, "top": 1.0}
    out = {row.g: row for row in quantiles(df, ["g"], "v", at).collect()}
    assert out.keys() == {"a", "b", None, "one"}
    for g, row in out.items():
        want = np.quantile([v for h, v in data if h == g and v is not None], list(at.values()))
        assert np.allclose([row[c] for c in at], want, atol=1e-12)
    none = quantiles(df.limit(0), [], "v", at).collect()
    assert len(none) == 1 and none[0].mid is None


def brute(metric, scores, labels, w):
    """The metric of rows with weights, pair by pair."""
    pos, neg = w * (labels == 1), w * (labels == 0)
    if metric == "ece":
        bins = np.floor(scores * 9)
        return sum(abs((pos - w * scores)[bins == b].sum()) for b in range(9)) / w.sum() if w.sum() else None
    if not pos.sum() or not neg.sum():
        return None
    if metric == "auroc":
        wins = (scores[:, None] > scores) + (scores[:, None] == scores) / 2
        return pos @ wins @ neg / (pos.sum() * neg.sum())
    above = scores[None, :] >= scores[:, None]
    return sum(p * (a @ pos) / max(1, a @ w) for p, a in zip(pos, above)) / pos.sum()


@pytest.mark.parametrize("metric", ["auroc", "auprc", "ece"])
def test_bootstrap_is_the_metric_of_weighted_rows(spark, metric):
    r = random.Random(4)
    data = [(m, None if m == "n" else "t", i % 70, r.choice(SCORES + [r.random() for _ in range(5)]), int(r.random() < 0.4)) for m in ("x", "y", "n") for i in range(90)]
    data += [("one", "t", i, 0.1 * i, 1) for i in range(5)] + [("x", "t", None, 0.3, 1), ("x", "t", 5, None, 1), ("x", "t", 6, 0.4, None), ("few", "t", 1, 0.5, 1), ("few", "t", 2, 0.5, 0)]
    df = spark.createDataFrame(data, "model string, task string, patient_id long, prob double, label int").repartition(7).withColumn("_h", F.lit("a clashing column"))
    kept = df.where("prob is not null and label is not null").withColumn("h", F.coalesce(drawn("patient_id", 7), F.lit(0))).collect()
    n = 23
    got = {(row.model, row.task, row.replicate): row.value for row in E.bootstrap(df, "patient_id", metric, n, 7).collect()}
    assert len(got) == n * 5
    for m, t in {(row.model, row.task) for row in kept}:
        mine = [row for row in kept if (row.model, row.task) == (m, t)]
        w = E.poisson_weights(np.array([row.h for row in mine]), n)
        for k in range(n):
            want = brute(metric, np.array([row.prob for row in mine]), np.array([row.label for row in mine]), w[:, k])
            assert (got[m, t, k] is None) == (want is None) and (want is None or abs(got[m, t, k] - want) < 1e-9)
    assert E.bootstrap(df.limit(0), "patient_id", metric, n).isEmpty()


def test_weights_are_poisson():
    w = E.poisson_weights(np.arange(-2000, 2000), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_metric_names(spark):
    df = spark.createDataFrame([("x", "t", 1, 0.5, 1)], "model string, task string, patient_id long, prob double, label int")
    with pytest.raises(ValueError):
        E.bootstrap(df, "patient_id", "f1", 5)


def test_neighbours(spark):
    r = random.Random(8)
    data = [(r.choice(["a", None, "b"]), k, r.choice([None, f"v{k}"])) for k in r.sample(range(-3000, 3000), 400)]
    data += [(g, k, None) for g, k, _ in data[:50]]
    out = neighbours(spark.createDataFrame(data, "g string, k long, v string").repartition(4), "g", "k", "v", 500).collect()
    assert len(out) == len(data)
    for row in out:
        mine = sorted((k, v) for g, k, v in data if g == row.g and v is not None)
        assert row._before == next((v for k, v in reversed(mine) if k <= row.k), None)
        assert row._after == next((v for k, v in mine if k >= row.k), None)


def test_a_hot_key_is_many_tasks(spark):
    """Rows of one key are cut into parts, of which no task has many, and the answer is that of a plain scan."""
    df = spark.range(40_000).selectExpr("7L as g", "id * 3600000000L as k", "if(id % 10 = 0, id, null) as v")
    rows = neighbours(df, "g", "k", "v")
    sizes = [x["count"] for x in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 20_000
    assert rows.where("_before is null or _before <> (k div 36000000000) * 10").isEmpty()


def test_dyadic_cover(spark):
    r = random.Random(9)
    pairs = [(0, 0), (5, 4), (0, (1 << W.LEVELS) - 1), (3, 3)] + [tuple(sorted(r.randrange(1 << 12) for _ in range(2))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", W.dyadic_cover("a", "b").alias("c"))
    for row in df.collect():
        assert len(row.c) <= 2 * W.LEVELS
        spans = sorted((p["at"] << p.level, ((p["at"] + 1) << p.level) - 1) for p in row.c)
        if row.b < row.a:
            assert not spans
            continue
        assert spans[0][0] == row.a and spans[-1][1] == row.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_intervals_of_a_hot_person(spark):
    """As all pairs tell, with open ends, ties, and rows that grow with anchors and intervals, not with their product."""
    import datetime as dt

    r = random.Random(10)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    visits = [(i, r.choice([1, 1, 1, 2, None]), day(a), r.choice([day(a + r.randint(-3, 90)), None])) for i, a in enumerate(r.choices(range(600), k=400))]
    anchors = [(i, r.choice([1, 2, 3, None]), dt.datetime(2000, 1, 1, 12) + dt.timedelta(r.randint(-5, 700))) for i in range(300)]
    a = spark.createDataFrame(anchors, "study_id long, person_id long, anchor_time timestamp")
    v = spark.createDataFrame(visits, "interval_id long, person_id long, start_date date, end_date date")
    found = W.encompassing_interval(a, v)
    assert found.columns == ["study_id", "person_id", "anchor_time", "start_date", "interval_id", "end_date"]
    got = {x.study_id: x.interval_id for x in found.collect()}
    want = {}
    for s, p, t in anchors:
        fit = [(b, i) for i, q, b, e in visits if p is not None and p == q and b <= t.date() and (e is None or e >= t.date())]
        if fit:
            want[s] = max(fit)[1]
    assert got == want
    assert W.encompassing_interval(a.limit(0), v).isEmpty() and W.encompassing_interval(a, v.limit(0)).isEmpty()


def test_histories_of_a_hot_person(spark):
    """Counts before each anchor day as all pairs tell; rows made are those of the result."""
    import datetime as dt

    from cohortspark.operators import features as X

    r = random.Random(11)
    time = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 300))
    events = [(r.choice([1, 1, 1, 2, None]), r.choice([10, 11, 12, None]), r.choice([time(), time(), None])) for _ in range(600)]
    anchors = [(i, r.choice([1, 1, 2, 3, None]), r.choice([time(), time(), None])) for i in range(60)]
    edges = [(10, 90), (11, 90), (11, 12), (10, 91)]
    e = spark.createDataFrame(events, "person_id long, concept_id long, event_time timestamp")
    a = spark.createDataFrame(anchors, "study_id long, person_id long, anchor_time timestamp")
    g = spark.createDataFrame(edges, "descendant long, ancestor long")
    persons = spark.createDataFrame([(1, dt.date(1950, 1, 1))], "person_id long, birth_time date")
    got = {(x.study_id, x.concept_id): x.value for x in X.history_features(e, a, g, persons).where("feature = 'count'").collect()}
    want = {}
    for s, p, t in anchors:
        for q, c, u in events:
            if None not in (p, q, t, u) and p == q and u.date() < t.date():
                for k in [c, *(up for down, up in edges if down == c)]:
                    want[s, k] = want.get((s, k), 0) + 1
    assert got == want and len(want) > 100


def test_day_bits(spark):
    """Distinct days and the nearest one of every ancestor, over windows of several words."""
    import datetime as dt

    from cohortspark.operators import concepts as C

    r = random.Random(12)
    day = lambda n: dt.datetime(2000, 1, 1, 5) + dt.timedelta(n)
    events = [(r.choice([1, 2]), r.choice([10, 11, 12]), day(r.randint(0, 400))) for _ in range(500)]
    anchors = [(i, r.choice([1, 2, 3]), day(r.randint(100, 401))) for i in range(20)]
    edges = [(10, 90, 1), (11, 90, 1), (11, 91, 2), (12, 92, 3)]
    e = spark.createDataFrame(events, "person_id long, concept_id long, event_time timestamp")
    a = spark.createDataFrame(anchors, "study_id long, person_id long, anchor_time timestamp")
    g = spark.createDataFrame(edges, "descendant long, ancestor long, level int")
    for most in (1, 63, 64, 300):
        got = {(x.study_id, x.ancestor): (x.n_days, x.days_since) for x in C.ancestor_features(e, a, g, most, 2, 1, 10).collect()}
        days = {}
        for s, p, t in anchors:
            for q, c, u in events:
                n = (t.date() - u.date()).days
                if p == q and 1 <= n <= most:
                    for down, up, level in edges:
                        if down == c and level <= 2:
                            days.setdefault((s, up), set()).add(n)
        assert got == {k: (len(v), min(v)) for k, v in days.items()}


def test_histories_meet_studies_as_buckets(spark):
    """A count that holds for many anchor days is a row for each TURNS of them, not one for each, where it meets the studies."""
    import datetime as dt

    from cohortspark.operators import features as X

    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    e = spark.createDataFrame([(1, 7, day(0)), (1, 7, day(20)), (1, 8, day(39))], "person_id long, concept_id long, event_time timestamp")
    a = spark.createDataFrame([(i, 1, day(i)) for i in range(40)], "study_id long, person_id long, anchor_time timestamp")
    g = spark.createDataFrame([(7, 70), (8, 70)], "descendant long, ancestor long")
    persons = spark.createDataFrame([(1, day(-9000))], "person_id long, birth_time timestamp")
    out = X.history_features(e, a, g, persons).where("feature = 'count'")
    want = {(i, c): float((i > 0) + (i > 20)) for i in range(1, 40) for c in (7, 70)}
    assert {(r.study_id, r.concept_id): r.value for r in out.collect()} == want
    assert "explode(sequence(turn#" not in out._jdf.queryExecution().optimizedPlan().toString()
