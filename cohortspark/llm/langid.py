"""Language identification by mixtures: a document's language shares by expectation-maximisation over its n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Bins of hashed n-grams.
BINS = 1 << 15
UNDETERMINED = "und"

#: Letters are Unicode's category L; a word character may also be a number such as one half, which isn't one.
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
#: The largest number of EM rounds, and the share in the mixture of all below which a language isn't tried in the set.
ROUNDS, LEAST_SHARE = 12, 0.01
#: ASCII other than letters counts as a space; bytes of other scripts stay.
_SHOWN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def ngram_bins(text: str) -> np.ndarray:
    """The bins of a whole text's byte trigrams, lower-cased, with a space at either end and runs of non-letters as one."""
    b = _SHOWN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    space = b == 32
    b = b[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the bins that occur."""
    bins = ngram_bins(text)
    if len(bins) < 2000:
        return np.unique(bins, return_counts=True)
    counts = np.bincount(bins, minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class MixtureModel:
    """Likelihoods of n-gram bins in each language."""

    languages: list[str]
    likelihood: np.ndarray  # bin x language
    #: An n-gram overlaps its neighbours: a document counts as so many fewer independent ones.
    overlap: float = 3.0
    penalty: float = 1.0
    rounds: int = ROUNDS
    least_share: float = LEAST_SHARE

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, smoothing: float = 0.1) -> MixtureModel:
        p = counts.T + smoothing
        return cls(languages, p / p.sum(0))

    def shares(self, p: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """The shares of the languages in p (n-gram x language) that EM finds, and their log likelihood."""
        share, n = start, counts.sum()
        for _ in range(rounds):
            joint = p * share
            new = (counts / joint.sum(1)) @ joint / n
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(counts @ np.log(p @ share))

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """The languages of a text with their shares, largest first; none for a text without letters (or null).

        From one language up, the set grows by the language with the next largest share in the mixture of all, as long as
        that raises the log likelihood of independent n-grams by more than half the logarithm of their number, and that
        share is `least_share` at least. EM stops when no share moves by 0.001, or after `rounds` rounds.
        """
        if not isinstance(text, str) or not has_letter(text) or not self.languages:
            return []
        bins, counts = ngram_counts(text)
        p, n = self.likelihood[bins], counts.sum() / self.overlap
        all_, _ = self.shares(p, counts, np.full(len(self.languages), 1 / len(self.languages)), self.rounds)
        order = np.argsort(-all_, kind="stable")
        single = counts @ np.log(p)
        best, chosen, share = float(single.max()) / self.overlap, [int(single.argmax())], np.ones(1)
        order = [chosen[0], *(i for i in order if i != chosen[0])]
        for size in range(2, len(order) + 1):
            if all_[order[size - 1]] < self.least_share:
                break
            start = np.maximum(all_[order[:size]], 1e-3)
            s, likelihood = self.shares(p[:, order[:size]], counts, start / start.sum(), self.rounds)
            now = likelihood / self.overlap - self.penalty * 0.5 * (size - 1) * np.log(max(n, 2))
            if now <= best:
                break
            best, chosen, share = now, order[:size], s
        return [(self.languages[chosen[i]], float(share[i])) for i in np.argsort(-share, kind="stable")]


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> MixtureModel:
    """Likelihoods from all documents with a label (doc_id, text, label; null texts and labels don't count). Tasks count their
    rows; only sums of n-gram bins by language leave them."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = text_batches(rows).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                sums[label] = sums.get(label, 0) + np.bincount(ngram_bins(text), minlength=BINS)
        for label, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"label": label, "bin": at, "n": s[at]})

    counted = rows.mapInPandas(count, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["label"].unique())
    counts = np.zeros((len(languages), BINS))
    counts[[languages.index(x) for x in counted["label"]], counted["bin"].to_numpy(int)] = counted["n"]
    return MixtureModel.of(languages, counts)


def identified(model: MixtureModel, text: str = "text") -> Column:
    """The languages of every whole text as a column: array of (lang, share), largest share first; empty for null texts and
    texts without a letter. The model is at most bins x languages; it goes along with the tasks' code."""

    @F.pandas_udf("array<struct<lang: string, share: double>>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"lang": a, "share": b} for a, b in model.infer(t)] for t in texts], dtype=object)

    return each(F.col(text))


def identify(docs: DataFrame, model: MixtureModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The languages of every whole text: key, lang_pred, score (its share, 0 to 1) and languages (all chosen, with shares).

    Null texts and texts without a letter are `und` with score 0, as is every text if no language was learned. Keys may be
    null or repeat; other columns are ignored; an empty table gives none.
    """
    found = text_batches(docs).select(key, identified(model, text).alias("languages"))
    first = F.try_element_at("languages", F.lit(1))
    share = F.least(F.lit(1.0), F.coalesce(first["share"], F.lit(0.0)))
    return found.select(key, F.coalesce(first["lang"], F.lit(UNDETERMINED)).alias("lang_pred"), share.alias("score"), "languages")
