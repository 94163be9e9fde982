import random
import re

import numpy as np
import pytest

from cohortspark.llm import graphs, jaccard_join, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def brute(rows, width, percent):
    sets = [brute_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                label[root(i)] = root(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            first[root(i)] = min(k, first.get(root(i), k))
    return sorted(((k, len(s), first.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed=0, families=25):
    r = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([4, 9, 11, 12, 13, 30, 80, 200, 700]))]
        for _ in range(r.choice([1, 2, 4, 12])):
            copy = list(base)
            for _ in range(int(len(base) * r.choice([0, 0.005, 0.01, 0.02, 0.04, 0.1]))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.3:
                copy += [f"y{r.randrange(10**6)}"]
            rows.append(" ".join(copy).title() if r.random() < 0.2 else "\n".join(copy))
    r.shuffle(rows)
    ids = r.sample(range(10**6), len(rows))
    return list(zip(ids, rows))


ODD = [(-5, None), (-4, ""), (-3, " \t\n"), (-2, "one"), (-1, "ONE"), (-6, "one two"), (-7, "One Two"), (-8, "é É"), (None, "no id at all here"), (-9, "rep rep rep rep"), (-9, "rep rep rep rep"), (-9, "another text with the same id"), (-10, "long " * 30_000), (-11, "Long " * 30_001)]


@pytest.mark.parametrize("width,percent,limits", [(3, 90, {}), (5, 80, {}), (3, 90, {"leaf_sets": 3, "pivots": 4}), (2, 70, {"leaf_sets": 4, "leaf_shingles": 500, "pivots": 3})])
def test_components(spark, documents, width, percent, limits):
    rows = corpus() + ODD
    got = jaccard_join.jaccard_components(documents(rows), width, percent, **limits).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)


def test_close_family_that_pivots_cannot_part(spark, documents):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(60)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = jaccard_join.jaccard_components(documents(rows), 3, 90, leaf_sets=5, pivots=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


def test_linked_sets_share_a_key_and_pass_the_sketch():
    r = np.random.default_rng(0)
    linked = 0
    for percent in (70, 80, 90, 95):
        for _ in range(600):
            n = int(r.integers(1, 1500))
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            swap = int(r.integers(0, max(1, n * (100 - percent) // 100)) + 1)
            b = np.unique(np.concatenate([a[: max(0, len(a) - swap)], r.integers(0, 1 << 63, int(r.integers(0, swap + 1))).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if len(b) and 100 * inter >= percent * (len(a) + len(b) - inter):
                linked += 1
                level = jaccard_join.level_of(max(len(a), len(b)), percent)
                keys = [dict(zip(jaccard_join.levels(len(s), percent), jaccard_join.block_keys(s, percent)))[level] for s in (a, b)]
                assert set(keys[0]) & set(keys[1]), (percent, len(a), len(b), inter)
                sketches = np.stack([jaccard_join.sketch(s, level) for s in (a, b)])
                assert jaccard_join.close_pairs(np.array([len(a), len(b)]), sketches, slice(0, 1), slice(1, 2), percent).all()
    assert linked > 1000


def test_forest_joins_what_the_pairs_join():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        close = r.random((n, n + 3)) < 1.5 / n
        left, right = np.arange(n), np.arange(100, 103 + n)
        edges = jaccard_join.forest(close, left, right)

        def parts(pairs):
            label = {x: x for p in pairs for x in p}

            def root(x):
                while label[x] != x:
                    x = label[x]
                return x

            for a, b in pairs:
                label[root(a)] = root(b)
            groups = {}
            for x in label:
                groups.setdefault(root(x), set()).add(int(x))
            return sorted(map(sorted, groups.values()))

        assert parts(edges) == parts([(left[i], right[j]) for i, j in zip(*np.nonzero(close))])


def test_shingles_equal_brute_force():
    texts = ["A b  c D", "a B c d", None, "", "x", "x y", "é É é", "A b c d e f a b c", "a\x0bb\x0cc d"]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(texts)]
    want = [brute_set(t, 3) for t in texts]
    for i in range(len(texts)):
        assert len(sets[i]) == len(want[i])
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_deduplicated(spark, documents):
    rows = corpus(1) + ODD
    df = documents(rows)
    out = jaccard_join.deduplicated(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    firsts = {c for k, _, c in brute(rows, 3, 90) if k == c and k is not None}
    assert got == sorted([*firsts, -9, None], key=str)  # two different texts have the id -9


def test_deduplicated_rows_without_id_and_repeated_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " end"), (None, "far away from all others"), (None, ""), (4, text), (4, text), (4, "something else entirely"), (9, None)]
    out = jaccard_join.deduplicated(documents([(*r, "en", f"s{i}", i) for i, r in enumerate(rows)]))
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert got == sorted([(4, text, "s4"), (4, "something else entirely", "s6"), (9, None, "s7"), (None, "", "s3"), (None, "far away from all others", "s2")], key=str)


def test_a_close_family_is_not_copied_to_pivots(spark, monkeypatch):
    r = random.Random(4)
    base = r.sample(range(10**6), 60)
    rows = [("r", i, 60, sorted(base[:55] + r.sample(range(10**6, 10**9), 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "region string, node long, size long, shingles array<long>")
    copied = []
    keep = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda d, name: copied.append((name, (w := keep(d, name))[0].count())) or w)
    assert jaccard_join.region_links(df, 90, leaf_sets=20).count() == 0
    assert sum(n for name, n in copied if name == "regions") == 0


def test_joined_equals_brute_force():
    r = np.random.default_rng(3)
    for percent in (50, 80, 90, 95):
        for n in (1, 2, 3, 40):
            sets = []
            for _ in range(n):
                if sets and r.random() < 0.7:
                    old = sets[int(r.integers(len(sets)))]
                    sets.append(np.unique(np.concatenate([old[r.random(len(old)) < 0.95], r.integers(0, 10**6, int(r.integers(0, 4)))])))
                else:
                    sets.append(np.unique(r.integers(0, 300, int(r.integers(1, 60)))))
            sets = [s if len(s) else np.array([7]) for s in sets]
            for first in (None, r.random(n) < 0.5):
                label = list(range(n))
                for i in range(n):
                    for j in range(i):
                        inter = len(np.intersect1d(sets[i], sets[j]))
                        if (first is None or first[i] != first[j]) and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                            low, high = sorted((label[i], label[j]))
                            label = [low if x == high else x for x in label]
                assert jaccard_join.joined(sets, percent, first).tolist() == label


def test_graph_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = {x.node: x.root for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark, documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0
    assert jaccard_join.deduplicated(documents([])).count() == 0


def with_passages(seed=5):
    """Texts that share passages but are far apart, some of them near copies, of many sizes."""
    r = random.Random(seed)
    passages = [[f"p{k}-{i}" for i in range(40)] for k in range(2)]
    rows = []
    for i in range(150):
        own = [f"o{i}-{j}" for j in range(r.choice([3, 15, 40, 90]))]
        text = r.choice(passages) + own if i % 3 else own + passages[0]
        for _ in range(1 if r.random() < 0.8 else 4):
            copy = list(text)
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent,cell", [(80, 7), (70, 40)])
def test_keys_of_many_sets_are_compared_in_cells(spark, documents, percent, cell):
    rows = with_passages() + ODD
    got = jaccard_join.jaccard_components(documents(rows), 3, percent, cell=cell).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, percent)


def test_cells_join_only_and_all_that_may_be_linked(spark):
    r = np.random.default_rng(2)
    size = np.concatenate([r.integers(32, 64, 80), [48] * 20, [51, 60, 63]])
    sketches = r.integers(0, 2, (len(size), 64)).astype(np.uint8)
    sketches[80:100] = sketches[80]
    edge = lambda close: {frozenset((i, j)) for i, j in zip(*np.nonzero(close)) if i != j}
    close = edge(jaccard_join.close_pairs(size, sketches, slice(None), slice(None), 80))
    members = spark.createDataFrame([(k, 6, i) for k in (1, 2) for i in range(len(size)) for _ in range(2)], "key long, level int, node long")
    rows = spark.createDataFrame([(i, 6, int(size[i]), bytearray(sketches[i].tobytes())) for i in range(len(size))], "node long, level int, size long, sketch binary")
    found = {frozenset((x.a, x.b)) for x in jaccard_join.large_keys_linked(members, rows, 80, cell=6).collect()}

    def parts(pairs):
        label = list(range(len(size)))
        for a, b in map(tuple, pairs):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    assert parts(found) == parts(close) and len(set(parts(found))) > 10


def test_a_large_key_does_not_join_what_sizes_rule_out():
    n = (1 << 16) + 2
    size = (1000 * 1.00044 ** np.arange(n)).astype(np.int64)
    half = n // 2
    size[half:] *= 10
    edges = np.array(jaccard_join.group_edges(np.arange(n), size, np.zeros((n, 64), np.uint8), 80))
    assert len(edges) and ((edges[:, 0] < half) == (edges[:, 1] < half)).all()


def test_parting_by_pivots():
    import pandas as pd

    far = [np.arange(100 * i, 100 * i + 50) for i in range(8)]
    near = [np.arange(k, k + 100) + 1000 * (i % 2) for i in range(8) for k in (0,)]
    share = lambda sets, percent: jaccard_join.parting(pd.DataFrame({"shingles": sets}), percent)
    assert share(far, 80) == 1 and share(near, 90) < 0.7 and share(far[:3], 80) == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_far_sets_in_one_region(spark, percent):
    r = random.Random(8)
    shared = list(range(40))
    sets = [shared + r.sample(range(100, 10**6), 60) for _ in range(60)]
    sets += [s[:-1] + [10**7 + i] for i, s in enumerate(sets[:10])]
    rows = [("r", i, len(s), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "region string, node long, size long, shingles array<long>")
    links = {(x.a, x.b) for x in jaccard_join.region_links(df, percent, leaf_sets=8, pivots=6).collect()}
    assert {tuple(sorted(x)) for x in links} == {(i, 60 + i) for i in range(10)}
