from fractions import Fraction

from pyspark.sql import functions as F

from cohortspark.llm import mixing


def filled(sizes, share=1.5, most=2.0):
    """Targets by resharing what is above, again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def docs(documents):
    rows = []
    for i in range(400):
        source = None if i % 9 == 0 else f"s{i % 7}" if i % 3 else "hot"
        rows.append((i, " ".join(["w"] * (i * 37 % 211)), "en", source, 1))
    return documents([*rows, (900, None, "en", "s1", 0), (901, " \n", "en", "s2", 0), (902, "a\x0bb é", "en", "", 0)])


def test_targets_and_words(spark, documents):
    df = docs(documents)
    got = mixing.mix_sources(df, block=8, shard=500).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert len(got) == 403
    want = filled(sizes)
    for s in want:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 8 + 0.01 * want[s], (s, taken[s], want[s])
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(5), block=8, shard=500).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_apportion_is_highest_quotients(spark):
    for weights, seats in (([50, 30, 12, 8], 10), ([1, 1, 1], 2), ([1000, 1, 1, 1, 1], 7), ([0, 5, 5], 3), ([7], 9)):
        df = spark.createDataFrame([(i, float(w), seats) for i, w in enumerate(weights)], "k int, w double, n int")
        got = {r.k: r.q for r in mixing.apportion(df, [], ["k"], "w", "n", "q").collect()}
        won = dict.fromkeys(range(len(weights)), 0)
        for _ in range(seats):
            won[max(won, key=lambda k: (Fraction(weights[k], 2 * won[k] + 1), -k))] += 1
        assert got == won


def test_texts_hold_what_is_taken(spark, documents):
    df = docs(documents).withColumns({"size": F.lit("x"), "pieces": F.lit(1)})
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(df, block=8, shard=500).collect()}
    out = mixing.mixed_texts(df, block=8, shard=500)
    assert out.columns == df.columns
    words, texts = {}, {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r["size"] == "x" and r.n_chars == len(r.text)
        if r.doc_id == 902:
            assert set(r.text) <= set(texts[902])
    assert words == {k: v for k, v in taken.items() if v}


def test_empty(spark, documents):
    assert mixing.mix_sources(documents([])).count() == 0
    assert mixing.mixed_texts(documents([])).count() == 0
    only = mixing.mix_sources(documents([(1, None)])).collect()
    assert [(r.taken, r.target) for r in only] == [(0, 0.0)]
