import os
import pickle
import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import langid, queries, toxicity

SYLLABLES = {"aa": "ka lo mi ren tas ve".split(), "bb": "zu pö schi gar enk".split(), "cc": "ña que llo ción dad".split()}


def text(r, lang, n=60, toxic=False):
    words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(4):
            words[r.randrange(n)] = r.choice(["grr", "bah", "xxoff"]) + r.choice(["", "ish", "er"])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(0)
    return [(i, text(r, lang, toxic=toxic), lang, toxic) for i in range(900) for lang in [r.choice(list(SYLLABLES))] for toxic in [r.random() < 0.3]]


ODD = [(-1, None), (-2, ""), (-3, "12 !? \n"), (None, "ka lo mi"), (-4, "ka" * 60_000), (-5, "\0\ud83d".encode("utf-8", "replace").decode())]


def test_toxicity_held_out(spark, documents, corpus):
    df = documents([(i, t, lang) for i, t, lang, _ in corpus] + ODD)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, _, x in corpus] + [(5, 0, 0), (None, 1, 1), (99999, 1, 1), (-1, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels.where(queries.fold(5) != 0), per_class=400)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == len(corpus) + len({k for k, _ in ODD})
    held = [(got[i].predicted, int(x)) for i, _, _, x in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.97
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    again = {r.doc_id: r.score for r in toxicity.score(df.repartition(3), model).collect()}
    assert all(abs(again[k] - r.score) < 1e-5 for k, r in got.items())  # the text alone decides


def test_toxicity_with_one_class_or_none(spark, documents):
    df = documents([(1, "a b"), (2, "c")])
    for rows, want in (([], 0.25), ([(1, 1, 0), (2, 1, 0)], 0.25), ([(1, 1, 1)], 0.75)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()} == {want}
    model = toxicity.fit(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(documents([]), model).count() == 0


def test_gradients():
    r = np.random.default_rng(0)
    model = toxicity.ConvolutionalClassifier.new()
    words = toxicity.split_words(["alpha beta gamma delta", "beta", "", "gamma gamma alpha"])
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    loss = lambda: float(np.mean(np.log1p(np.exp(np.where(y == 1, -1, 1) * model.logits(words)))))
    before = loss()
    memory = {}
    for _ in range(60):
        model.step(words, y, w, 0.05, memory, np.ones(len(words.distinct), bool))
    assert loss() < before / 3 and r is not None


def test_words_do_not_leak_between_texts():
    model = toxicity.ConvolutionalClassifier.new()
    texts = ["one two three", "", "four", "five six", None, "one two three"]
    alone = np.concatenate([model.logits(toxicity.split_words([t])) for t in texts])
    assert np.allclose(model.logits(toxicity.split_words(texts)), alone, atol=1e-5)


def test_thresholds():
    logit, y = np.array([3.0, 2, 1, 0, -1]), np.array([1, 1, 0, 0, 0])
    assert toxicity.best_threshold(logit, y, np.ones(5)) == 1.5
    assert toxicity.best_threshold(np.array([1.0, 1, 0]), np.array([1, 0, 0]), np.ones(3)) == 0.5


def test_language_held_out(spark, documents, corpus):
    df = documents([(i, t, lang) for i, t, lang, _ in corpus] + ODD + [(-9, "ka lo", None)])
    model = langid.fit(df.where(queries.fold(3) != 1))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [got[i].lang_pred == lang for i, _, lang, _ in corpus if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200 and np.mean(held) > 0.99
    assert {got[k].lang_pred for k in (-1, -2, -3)} == {"und"} and got[-1].score == 0
    assert got[-4].lang_pred == "aa" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_shares(corpus):
    counts = np.zeros((3, langid.BINS))
    for _, t, lang, _ in corpus:
        counts[list(SYLLABLES).index(lang)] += np.bincount(langid.ngram_bins(t), minlength=langid.BINS)
    model = langid.MixtureModel.of(list(SYLLABLES), counts)
    r = random.Random(5)
    both = dict(model.infer(text(r, "aa", 140) + " " + text(r, "cc", 60)))
    assert set(both) == {"aa", "cc"} and abs(both["aa"] - 0.7) < 0.1
    assert [k for k, _ in model.infer(text(r, "bb", 50))] == ["bb"]
    assert model.infer(None) == [] and model.infer("123") == []


def test_no_languages(spark, documents):
    df = documents([(1, "abc")])
    assert langid.identify(df, langid.fit(df)).first().lang_pred == "und"
    assert langid.identify(documents([]), langid.fit(documents([]))).count() == 0


def test_all_labelled_rows_are_learned_from(spark, documents):
    """A word that only rows beyond the driver's share have tells as much as one of these."""
    r = random.Random(4)
    rows = [(i, text(r, "aa") + (f" vile{i % 40:02}" if i % 3 == 0 else ""), "aa") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)], "doc_id long, toxic int")
    df = documents(rows)
    model = toxicity.fit(df, labels, per_class=30)
    assert model.memory is None and model.languages == ["aa"]
    got = {x.doc_id: x.predicted for x in toxicity.score(df, model).collect()}
    assert np.mean([got[i] == int(i % 3 == 0) for i in range(3000)]) > 0.97
    # counts are of all rows' words, thresholds the best cut of all held rows
    whole = toxicity.split_words([t for _, t, _ in rows])
    n = np.bincount(whole.bins[whole.distinct], minlength=toxicity.LANGUAGE_BINS) + 0.5
    assert np.allclose(model.language_likelihood[:, 0], np.log(n / n.sum()))


def test_thresholds_of_tasks(spark, documents):
    r = random.Random(6)
    texts = [text(r, "aa", 12, i % 4 == 0) for i in range(400)]
    y = np.array([int(i % 4 == 0) for i in range(400)])
    model = toxicity.train(texts, y, np.ones(400), ["aa"] * 400, np.arange(400) % 4 == 1, epochs=1)
    df = spark.createDataFrame([(t, int(c), i % 2 == 0) for i, (t, c) in enumerate(zip(texts, y))], "text string, toxic int, held boolean")
    logit = model.logits(toxicity.split_words(texts[::2])).astype(float)
    assert toxicity.thresholds(model, df) == pytest.approx([toxicity.best_threshold(logit, y[::2], np.ones(200))], abs=1e-5)
    again = model.of_parameters(model.parameters())
    assert np.allclose(again.logits(toxicity.split_words(texts)), model.logits(toxicity.split_words(texts)), atol=1e-6)


def test_refining_holds_one_model(spark, monkeypatch):
    """What goes to the tasks is one model in single precision, and the driver drops it after each pass."""
    sent, own = [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        sent.append((len(pickle.dumps(value)), own(self, value)))
        return sent[-1][1]

    r = random.Random(7)
    rows = [(i, text(r, "aa", 12, i % 4 == 0), "aa", int(i % 4 == 0), i % 3 == 0) for i in range(200)]
    texts, y = [x[1] for x in rows], np.array([x[3] for x in rows])
    first = toxicity.train(texts, y, np.ones(200), ["aa"] * 200, np.arange(200) % 3 == 0, epochs=1)
    before = first.parameters()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, held boolean")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    model = toxicity.refined(first, df, {0: 150, 1: 50})
    assert len(sent) == toxicity.PASSES + 1 and max(n for n, _ in sent) < 18_000_000
    assert not any(os.path.exists(b._path) for _, b in sent)
    assert np.array_equal(first.parameters(), before) and (model.table != first.table).any()


def test_languages_of_all_documents(spark, documents):
    rows = [(i, "ka lo mi", "aa") for i in range(2500)] + [(5000 + i, "zu gar", "bb") for i in range(10)]
    n = np.stack([2500 * np.bincount(langid.ngram_bins("ka lo mi"), minlength=langid.BINS), 10 * np.bincount(langid.ngram_bins("zu gar"), minlength=langid.BINS)])
    assert np.allclose(langid.fit(documents(rows)).likelihood, langid.MixtureModel.of(["aa", "bb"], n).likelihood)
