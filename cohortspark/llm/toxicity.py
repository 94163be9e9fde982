"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import cumulated, value_part
from .common import removed, small, text_batches, written

#: Labelled rows of each class, about, that the driver fits a first model to; where there are more, all rows refine it.
PER_CLASS = 2000
#: Passes of all labelled rows, and rows of a task that takes steps by itself.
PASSES, ROWS_A_TASK = 2, 8192
#: Rows of the embedding table, its dimensions, filters of each width, and bytes of the word beginnings hashed beside words.
SLOTS, DIMENSIONS, WIDTHS, FILTERS, BEGINNINGS = 1 << 18, 8, (1, 2, 3), 8, (4, 5, 6, 7)
#: Bins of words by which the language of a text is told.
LANGUAGE_BINS = 4096
#: Bytes of text that are scored at once.
CHUNK = 1 << 19

_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `most` characters, a longer text alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= most):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


@dataclass
class Words:
    """The words of some texts: for each word its distinct one, for each text where its words start (and the end of all)."""

    distinct: np.ndarray  # for each word the place of its form
    forms: np.ndarray  # for each form the slots of the word and its beginnings (-1: none)
    bins: np.ndarray  # for each form its bin for languages
    starts: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.distinct[self.starts[i] : self.starts[i + 1]]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _FACTOR
    return h ^ (h >> np.uint64(32))


def split_words(texts: list[str | None]) -> Words:
    """Runs of ASCII letters and digits and of other bytes, lower-cased, of whole texts, hashed in one go."""
    each = [(t.lower() if isinstance(t, str) else "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in each])
    data = np.frombuffer(b"\n".join(each) + b"\n", np.uint8)
    inside = _LETTER[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.concatenate(([0], np.searchsorted(first, ends)))
    if not len(first):
        return Words(np.empty(0, np.int64), np.empty((0, 1 + len(BEGINNINGS)), np.int64), np.empty(0, np.int64), starts)
    length = last - first
    at = np.flatnonzero(inside)
    begin = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), 1099511628211, np.uint64))
        hashes = mixed(np.add.reduceat(data[at] * powers[place], begin))
        _, sample, distinct = np.unique(hashes, return_index=True, return_inverse=True)
        first, length, hashes = first[sample], length[sample], hashes[sample]
        forms = np.full((len(first), 1 + len(BEGINNINGS)), -1, np.int64)
        forms[:, 0] = hashes % np.uint64(SLOTS)
        h = np.zeros(len(first), np.uint64)
        for k in range(max(BEGINNINGS)):
            h += data[np.minimum(first + k, len(data) - 1)] * powers[k] if k < len(powers) else np.uint64(0)
            if k + 1 in BEGINNINGS:
                forms[:, 1 + BEGINNINGS.index(k + 1)] = np.where(length >= k + 1, (mixed(h + np.uint64(k + 1)) % np.uint64(SLOTS)).astype(np.int64), -1)
    return Words(distinct.reshape(-1), forms, (hashes >> np.uint64(40)).astype(np.int64) % LANGUAGE_BINS, starts)


@dataclass
class ConvolutionalClassifier:
    """Embeddings of a word's hash and its beginnings' are summed, filters of several widths slide over the words, each
    filter's largest output counts, and a linear layer makes a logit of them. Thresholds belong to languages, which are told
    from the words themselves."""

    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    language_likelihood: np.ndarray | None = None  # bin x language, logarithms
    thresholds: np.ndarray | None = None
    constant: float | None = None  # where the labels had one class only
    memory: dict | None = None  # sums of squared gradients, for more steps

    def parameters(self) -> np.ndarray:
        """All weights and then, beside them, the sums of their squared gradients: (row, 16), 17 MB. Rows of the table come first."""
        names = ["out", *(f"{k}{w}" for w in WIDTHS for k in "wb"), "out_bias"]
        weights = [self.out, *(x[w] for w in WIDTHS for x in (self.filters, self.bias)), np.array([self.out_bias])]
        past = [np.broadcast_to(self.memory.get(n, 1e-8), np.shape(w)) for n, w in zip(names, weights)]
        flat = [np.concatenate([np.ravel(x) for x in part]) for part in (weights, past)]
        rest = np.zeros((-(-len(flat[0]) // DIMENSIONS), 2 * DIMENSIONS), np.float32)
        for k, x in enumerate(flat):
            rest[:, k * DIMENSIONS : (k + 1) * DIMENSIONS] = np.pad(x, (0, -len(x) % DIMENSIONS)).reshape(-1, DIMENSIONS)
        table = np.concatenate([self.table, self.memory.get("table", np.full_like(self.table, 1e-8))], 1)
        return np.concatenate([table, rest])

    def of_parameters(self, p: np.ndarray) -> ConvolutionalClassifier:
        """This classifier, whose own table isn't looked at, with other `parameters`."""
        size, out = SLOTS + 1, replace(self, filters={}, bias={}, memory={})
        out.table, out.memory["table"] = p[:size, :DIMENSIONS].astype(np.float32), p[:size, DIMENSIONS:].astype(np.float32)
        weights, past = (np.ravel(p[size:, k * DIMENSIONS : (k + 1) * DIMENSIONS]) for k in (0, 1))
        at = 0

        def taken(name: str, like: np.ndarray) -> np.ndarray:
            nonlocal at
            end = at + np.size(like)
            out.memory[name] = past[at:end].reshape(np.shape(like))
            found = weights[at:end].reshape(np.shape(like)).astype(np.float32)
            at = end
            return found

        out.out = taken("out", self.out)
        for w in WIDTHS:
            out.filters[w], out.bias[w] = taken(f"w{w}", self.filters[w]), taken(f"b{w}", self.bias[w])
        out.out_bias = float(taken("out_bias", np.zeros(1))[0])
        out.memory["out_bias"] = float(out.memory["out_bias"][0])
        return out

    @classmethod
    def new(cls, seed: int = 5) -> ConvolutionalClassifier:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.1, (SLOTS + 1, DIMENSIONS)).astype(np.float32)
        table[SLOTS] = 0
        filters = {w: r.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        return cls(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))

    def embedded(self, forms: np.ndarray) -> np.ndarray:
        """A row for each form, and a row of zeros for padding."""
        e = np.zeros((len(forms) + 1, DIMENSIONS), np.float32)
        for c in range(forms.shape[1]):
            e[:-1] += self.table[forms[:, c]]  # slot -1 is the last row, which stays zero
        return e

    def pooled(self, words: Words, places: bool = False, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(text x filter: the largest output, the place it comes from if asked for, the padded words)."""
        n, pad = len(words.starts) - 1, len(words.forms)
        size = np.diff(words.starts)
        begin = words.starts[:-1] + np.arange(n) * max(WIDTHS)
        padded = np.full(len(words.distinct) + n * max(WIDTHS) + max(WIDTHS), pad, np.int64)
        padded[np.arange(len(words.distinct)) + np.repeat(np.arange(n) * max(WIDTHS), size)] = words.distinct if kept is None else np.where(kept, words.distinct, pad)
        e = self.embedded(words.forms)
        most, where = [], []
        # windows start at a text's words, or at its padding if it has none; reduceat wants a start and an end
        cuts = np.stack([begin, begin + np.maximum(size, 1)], 1).reshape(-1)
        length = len(padded) - max(WIDTHS) + 1
        for w in WIDTHS:
            out = (e @ self.filters[w][0])[padded[:length]]
            for k in range(1, w):
                out += (e @ self.filters[w][k])[padded[k : k + length]]
            most.append(np.maximum.reduceat(out, cuts, axis=0)[::2] + self.bias[w])
            if places:
                where.append(np.stack([begin[i] + out[begin[i] : begin[i] + max(size[i], 1)].argmax(0) for i in range(n)]))
        return np.concatenate(most, 1), np.concatenate(where, 1) if places else None, padded

    def logits(self, words: Words) -> np.ndarray:
        return np.maximum(self.pooled(words)[0], 0) @ self.out + self.out_bias

    def step(self, words: Words, y: np.ndarray, weight: np.ndarray, rate: float, memory: dict, kept: np.ndarray) -> None:
        """One step of Adagrad on a batch; gradients reach only the words that the pooling chose. kept: which words count
        this time. Leaving words out by chance makes the filters learn every telling word, not the loudest of each text."""
        z, where, padded = self.pooled(words, True, kept)
        h = np.maximum(z, 0)
        g = weight * (1 / (1 + np.exp(-(h @ self.out + self.out_bias))) - y) / len(y)
        dz = g[:, None] * self.out * (z > 0)
        e = self.embedded(words.forms)
        de = np.zeros_like(e)

        def move(name, parameter, gradient):
            memory[name] = memory.get(name, 1e-8) + gradient * gradient
            parameter -= (rate * gradient / np.sqrt(memory[name])).astype(parameter.dtype)

        moves = [("out", self.out, h.T @ g)]
        for j, w in enumerate(WIDTHS):
            d, at = dz[:, j * FILTERS : (j + 1) * FILTERS], where[:, j * FILTERS : (j + 1) * FILTERS]
            grad = np.zeros_like(self.filters[w])
            for k in range(w):
                form = padded[at + k]
                grad[k] = np.einsum("nf,nfd->df", d, e[form])
                np.add.at(de, form, d[:, :, None] * self.filters[w][k].T[None])
            moves += [(f"w{w}", self.filters[w], grad), (f"b{w}", self.bias[w], d.sum(0))]
        touched = np.flatnonzero(np.abs(de[:-1]).sum(1))
        rows, at = np.unique(words.forms[touched], return_inverse=True)
        dt = np.zeros((len(rows), DIMENSIONS), np.float32)
        np.add.at(dt, at.reshape(len(touched), -1), de[touched][:, None, :])
        rows, dt = rows[rows >= 0], dt[rows >= 0]
        if "table" not in memory:
            memory["table"] = np.full_like(self.table, 1e-8)
        past = memory["table"]
        past[rows] += dt**2
        self.table[rows] -= rate * dt / np.sqrt(past[rows])
        for m in moves:
            move(*m)
        memory["out_bias"] = memory.get("out_bias", 1e-8) + g.sum() ** 2
        self.out_bias -= float(rate * g.sum() / np.sqrt(memory["out_bias"]))

    def language_of(self, words: Words) -> np.ndarray:
        """The place in `languages` of each text, by its words' likelihoods."""
        if len(self.languages) < 2:
            return np.zeros(len(words.starts) - 1, np.int64)
        each = np.concatenate([self.language_likelihood[words.bins], np.zeros((1, len(self.languages)))])[np.append(words.distinct, len(words.forms))]
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
        return (sums[words.starts[1:]] - sums[words.starts[:-1]]).argmax(1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; 0.5 is the threshold of its language."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        words = split_words(texts)
        logit = self.logits(words) - self.thresholds[self.language_of(words)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(float)))


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the highest F1, in the middle of the gap it lies in."""
    order = np.argsort(-logit, kind="stable")
    v, hit, all_ = logit[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    f1[:-1][v[:-1] == v[1:]] = -1  # equal logits aren't parted
    i = int(f1.argmax())
    return float(v[i] - 1 if i + 1 == len(v) else (v[i] + v[i + 1]) / 2)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, languages: list[str | None], held: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.05, dropped: float = 0.5, seed: int = 5) -> ConvolutionalClassifier:
    """Fits a classifier to labelled texts; those marked in `held` only set the thresholds.

    weight: how many rows of the whole a text stands for. A language with fewer than five held texts of a class takes the
    threshold of all. One class only: every score is 0.25 (no label 1) or 0.75 (no label 0).
    """
    model = ConvolutionalClassifier.new(seed)
    if not len(y) or y.min() == y.max():
        model.constant = 0.25 if not len(y) or y[0] == 0 else 0.75
        return model
    fit = np.flatnonzero(~held)
    if not len(fit) or y[fit].min() == y[fit].max():
        fit, held = np.arange(len(y)), np.ones(len(y), bool)
    r, memory = np.random.default_rng(seed), {}
    balance = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    for _ in range(epochs):
        r.shuffle(fit)
        for i in range(0, len(fit), batch):
            part = fit[i : i + batch]
            words = split_words([texts[j] for j in part])
            model.step(words, y[part], balance[part], rate, memory, r.random(len(words.distinct)) >= dropped)
    model.memory = memory
    model.languages = sorted({x for x in languages if x is not None})
    counts = np.full((LANGUAGE_BINS, max(1, len(model.languages))), 0.5)
    for i, j in chunks(texts):
        words = split_words(texts[i:j])
        for k, x in enumerate(languages[i:j]):
            if x is not None:
                np.add.at(counts[:, model.languages.index(x)], words.bins[words.of(k)], 1)
    model.language_likelihood = np.log(counts / counts.sum(0))
    if not held.any() or y[held].min() == y[held].max():
        held = np.ones(len(y), bool)
    logit, told = np.empty(len(texts), np.float32), np.empty(len(texts), np.int64)
    for i, j in chunks(texts):
        words = split_words(texts[i:j])
        logit[i:j], told[i:j] = model.logits(words), model.language_of(words)
    all_ = best_threshold(logit[held], y[held], weight[held])
    model.thresholds = np.full(max(1, len(model.languages)), all_)
    for i in range(len(model.languages)):
        own = held & (told == i)
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 5:
            model.thresholds[i] = best_threshold(logit[own], y[own], weight[own])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 3) -> ConvolutionalClassifier:
    """A classifier from all labelled rows: labels (doc_id, toxic), docs (doc_id, text, lang).

    Rows without label, text or partner don't count; of several labels of a document the highest does, of several texts the
    least. About per_class rows of each class come to the driver for a first model. If these aren't all, the weights, the words
    of languages and the thresholds then come from all rows, in tasks; a quarter of the rows sets the thresholds.
    """
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(small(labels), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "toxic", "one.*")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4)) == 0
    rows, path = written(rows.select("doc_id", "text", "lang", "toxic", part.alias("held")), "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    share = F.create_map(*(F.lit(x) for c in (0, 1) for x in (c, min(1.0, per_class / max(1, sizes.get(c, 0))))))
    first = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000)
    got = first.toPandas().sort_values(["doc_id", "text"])
    y = got["toxic"].to_numpy(int)
    sizes_in = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([sizes.get(c, 0) / sizes_in[c] for c in y], float)
    model = train(list(got["text"]), y, weight, [x if isinstance(x, str) else None for x in got["lang"]], got["held"].to_numpy(bool))
    if len(got) < sum(sizes.values()) and model.constant is None:
        model = refined(model, text_batches(rows), sizes)
    removed(docs.sparkSession, path)
    return model if model is None else replace(model, memory=None)


def refined(model: ConvolutionalClassifier, rows: DataFrame, sizes: dict[int, int], passes: int = PASSES) -> ConvolutionalClassifier:
    """The model after passes over all rows (doc_id, text, lang, toxic, held), with the words of languages and thresholds of all.

    In a pass each task starts from the same model and takes steps over its own rows; a weight becomes the mean of what the tasks
    that moved it made of it (iterative parameter mixing). Tasks get and give a model, whose size is fixed, never rows. The driver
    holds one model, sends it once a pass and drops what it sent after it.
    """
    tasks, context = -(-sum(sizes.values()) // ROWS_A_TASK), rows.sparkSession.sparkContext
    balance = {c: 0.5 * sum(sizes.values()) / max(1, n) for c, n in sizes.items()}
    names = [f"p{i}" for i in range(2 * DIMENSIONS)]
    fits = rows.where("not held").select("doc_id", "text", "toxic").repartition(tasks, "doc_id")
    p = model.parameters()
    model = replace(model, table=model.table[:0], memory=None)
    for k in range(passes):
        told = context.broadcast((model, p))

        def moved(batches: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            start, before = told.value
            own, r = start.of_parameters(before), np.random.default_rng(k)
            steps = 0
            for batch in batches:
                texts, y = list(batch["text"]), batch["toxic"].to_numpy(int)
                order, weight = r.permutation(len(y)), np.array([balance[c] for c in y])
                for i in range(0, len(y), 32):
                    part = order[i : i + 32]
                    words = split_words([texts[j] for j in part])
                    own.step(words, y[part], weight[part], 0.05, own.memory, r.random(len(words.distinct)) >= 0.5)
                    steps += 1
            if steps:
                after = own.parameters()
                rows_ = np.flatnonzero((after != before).any(1))
                yield pd.DataFrame(after[rows_], columns=names).assign(slot=rows_.astype(np.int32))

        mean = fits.mapInPandas(moved, ", ".join(f"{n} float" for n in names) + ", slot int").groupBy("slot").agg(*(F.avg(n).cast("float").alias(n) for n in names)).toArrow()
        for j, n in enumerate(names):
            p[mean["slot"].to_numpy(), j] = mean[n].to_numpy()
        told.destroy()
        del mean
    model = replace(model.of_parameters(p), memory=None)
    model = with_languages(model, rows)
    model.thresholds = thresholds(model, rows)
    return model


def with_languages(model: ConvolutionalClassifier, rows: DataFrame) -> ConvolutionalClassifier:
    """The model with likelihoods of the words of all rows in each language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                texts = list(own["text"])
                for i, j in chunks(texts):
                    words = split_words(texts[i:j])
                    sums[lang] = sums.get(lang, 0) + np.bincount(words.bins[words.distinct], minlength=LANGUAGE_BINS)
        for lang, n in sums.items():
            yield pd.DataFrame({"lang": lang, "bin": np.arange(LANGUAGE_BINS), "n": n})

    counted = rows.where("lang is not null").select("lang", "text").mapInPandas(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.full((LANGUAGE_BINS, max(1, len(languages))), 0.5)
    counts[counted["bin"].to_numpy(int), [languages.index(x) for x in counted["lang"]]] += counted["n"].to_numpy(float)
    return replace(model, languages=languages, language_likelihood=np.log(counts / counts.sum(0)))


def thresholds(model: ConvolutionalClassifier, rows: DataFrame) -> np.ndarray:
    """The cut of each language as in `best_threshold`, from the held rows (all, if these have one class only). Rows are summed up
    by their logit and ordered in parts."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for i, j in chunks(texts):
                words = split_words(texts[i:j])
                yield pd.DataFrame({"lang": told.value.language_of(words), "logit": told.value.logits(words).astype(float), "y": batch["toxic"].to_numpy(int)[i:j]})

    held = rows.where("held")
    if held.select("toxic").distinct().count() < 2:
        held = rows
    each = held.select("text", "toxic").mapInPandas(said, "lang long, logit double, y long").select(F.explode(F.array(F.lit(-1).cast("long"), "lang")).alias("lang"), (-F.col("logit")).alias("key"), "y")
    each = each.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hit"))
    c = cumulated(each, ["lang"], "key", ["n", "hit"], value_part(F.col("key")))
    upto = lambda x: F.coalesce(f"{x}_before", F.lit(0)) + F.col(x)
    c, path = written(c.select("lang", "key", "n_all", "hit_all", (2 * upto("hit") / (upto("n") + F.col("hit_all"))).alias("f1")), "cuts")
    best = c.groupBy("lang").agg(F.max(F.struct("f1", -F.col("key"))).alias("b"), F.max("n_all").alias("n"), F.max("hit_all").alias("hit")).select("lang", (-F.col("b").getField("col2")).alias("at"), "n", "hit")
    found = {r.lang: r for r in c.join(F.broadcast(best), "lang").groupBy("lang", "at", "n", "hit").agg(F.min(F.when(F.col("key") > F.col("at"), F.col("key"))).alias("next")).collect()}  # a row a language
    cut = lambda r: -r.at - 1 if r.next is None else -(r.at + r.next) / 2
    own = {k: cut(r) for k, r in found.items() if k == -1 or min(r.hit, r.n - r.hit) >= 5}
    removed(rows.sparkSession, path)
    told.destroy()
    return np.array([own.get(i, own[-1]) for i in range(max(1, len(model.languages)))])


def scored(model: ConvolutionalClassifier, text: str = "text") -> Column:
    """The score of every whole text as a column; null and empty texts are scored as empty. The model is a table of fixed
    size and goes along with the tasks' code."""

    @F.pandas_udf("double")
    def each(texts: pd.Series) -> pd.Series:
        texts = list(texts)
        return pd.Series(np.concatenate([np.empty(0), *(model.scores(texts[i:j]) for i, j in chunks(texts))]))

    return each(F.col(text))


def score(docs: DataFrame, model: ConvolutionalClassifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from 0.5 on) of every whole text. Keys may be null or repeat; other columns are
    ignored; an empty table gives none."""
    return text_batches(docs).select(key, scored(model, text).alias("score")).select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
