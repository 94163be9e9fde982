"""The classifiers and the curve against plain computations, one text, word, filter or cell at a time."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import langid, sharding, toxicity

TEXTS = ["alpha beta gamma", "beta", "", "Alpha-alpha beta42 gamma delta epsilon beta", "x y z " * 40, "grr grrish bah. ok", "ß é 日本 alpha"]


def mixed(h):
    """One 64-bit mixing of the module's, alone."""
    return int(toxicity.mixed(np.array([h], np.uint64))[0])


def forms(word):
    """The table's rows of a word: its own and those of its beginnings."""
    m, p = 1 << 64, 1099511628211
    powers = [pow(p, k + 1, m) for k in range(len(word))]
    whole = mixed(sum(b * q for b, q in zip(word, powers)) % m)
    out = [whole % toxicity.SLOTS]
    for k in toxicity.BEGINNINGS:
        if len(word) >= k:
            h = sum(b * q for b, q in zip(word[:k], powers)) % m
            out.append(mixed((h + k) % m) % toxicity.SLOTS)
    return out


def naive_logit(model, text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    vectors = [sum(model.table[f] for f in forms(w)) for w in words]
    total = model.out_bias
    for j, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for at in range(max(1, len(words))):
                value = model.bias[width][f]
                for k in range(width):
                    if at + k < len(words):
                        value = value + vectors[at + k] @ model.filters[width][k][:, f]
                best = max(best, value)
            total += max(best, 0) * model.out[j * toxicity.FILTERS + f]
    return total


def test_forward_pass():
    model = toxicity.ConvolutionalClassifier.new(11)
    for w in toxicity.WIDTHS:
        model.bias[w] += 0.05
    model.out_bias = 0.3
    got = model.logits(toxicity.split_words(TEXTS))
    assert np.allclose(got, [naive_logit(model, t) for t in TEXTS], atol=1e-4)


def test_threshold():
    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(2, 25))
        logit, y, weight = np.round(r.normal(size=n), 1), r.integers(0, 2, n), r.uniform(0.5, 3, n)
        if y.min() == y.max():
            continue
        f1 = lambda cut: 2 * (weight * y)[logit > cut].sum() / (weight[logit > cut].sum() + (weight * y).sum())
        values = np.unique(logit)
        cuts = [*((values[:-1] + values[1:]) / 2), values[0] - 1]
        assert f1(toxicity.best_threshold(logit, y, weight)) == pytest.approx(max(f1(c) for c in cuts))


def naive_infer(model, text):
    """Every n-gram a row of its own; EM as written, then the sets of growing size by penalised likelihood."""
    if not langid.has_letter(text):
        return []
    rows = [model.likelihood[b] for b in langid.ngram_bins(text)]

    def em(columns, start):
        share = list(start)
        for _ in range(model.rounds):
            new = [0.0] * len(columns)
            for row in rows:
                joint = [s * row[c] for s, c in zip(share, columns)]
                for k, v in enumerate(joint):
                    new[k] += v / sum(joint) / len(rows)
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < 1e-3:
                break
        return share, sum(np.log(sum(s * row[c] for s, c in zip(share, columns))) for row in rows)

    n = len(model.languages)
    all_, _ = em(range(n), [1 / n] * n)
    single = [sum(np.log(row[c]) for row in rows) for c in range(n)]
    first = max(range(n), key=lambda c: (single[c], -c))
    order = [first, *sorted((c for c in range(n) if c != first), key=lambda c: -all_[c])]
    best, chosen, share = single[first] / model.overlap, [first], [1.0]
    for size in range(2, n + 1):
        if all_[order[size - 1]] < model.least_share:
            break
        start = [max(all_[c], 1e-3) for c in order[:size]]
        s, likelihood = em(order[:size], [x / sum(start) for x in start])
        now = likelihood / model.overlap - model.penalty * 0.5 * (size - 1) * np.log(max(len(rows) / model.overlap, 2))
        if now <= best:
            break
        best, chosen, share = now, order[:size], s
    return sorted(((model.languages[c], s) for c, s in zip(chosen, share)), key=lambda x: -x[1])


def test_mixture_inference():
    r = random.Random(2)
    syllables = {"aa": "ka lo mi ren tas ve".split(), "bb": "zu pö schi gar enk".split(), "cc": "ña que llo ción dad ka".split()}
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    counts = np.stack([sum(np.bincount(langid.ngram_bins(say(x, 50)), minlength=langid.BINS) for _ in range(20)) for x in syllables])
    model = langid.MixtureModel.of(list(syllables), counts)
    texts = [say("aa", 30), say("bb", 3), say("aa", 25) + " " + say("cc", 25), say("aa", 20) + " " + say("bb", 20) + " " + say("cc", 20), "12 !", "ka", say("cc", 1)]
    sizes = set()
    for t in texts:
        got, want = model.infer(t), naive_infer(model, t)
        assert [x for x, _ in got] == [x for x, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
        sizes.add(len(got))
    assert sizes >= {0, 1, 2, 3}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (3, 5)])
def test_the_curve_visits_neighbours(spark, dims, bits):
    """Every cell once; each next to the one before; every half, quarter or eighth of a level is one run."""
    names = [f"d{i}" for i in range(dims)]
    cells = spark.range(1 << bits * dims).select(*(F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(n) for i, n in enumerate(names)))
    rows = sorted((r.curve, *(r[n] for n in names)) for r in sharding.hilbert_index(cells, names, bits).collect())
    assert [r[0] for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in itertools.pairwise(rows))
    for level in range(1, bits):
        size = 1 << level * dims
        for i in range(0, len(rows), size):
            assert len({tuple(c >> level for c in r[1:]) for r in rows[i : i + size]}) == 1


def test_shards_follow_the_curve(spark, documents):
    r = random.Random(3)
    df = documents([(i, "w " * r.randint(0, 500), r.choice("abcd"), r.choice("stuvw")) for i in range(700)])
    rows = sharding.shard_documents(df, 9).collect()
    rows.sort(key=lambda x: (x.shard, x.slot))
    place = [x.curve for x in rows]
    assert place == sorted(place)
    cells = {(x.lang_level, x.source_level, x.length_level): x.curve for x in rows}
    assert len(set(cells.values())) == len(cells) > 30
