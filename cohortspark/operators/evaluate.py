"""Evaluation of predictions (model, task, patient_id, label 0/1, prob): tasks and models are columns, not loops."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import expit, logit
from ..sources.io import written
from .running import cumulated, score_part
from .splits import drawn

BY = ["model", "task"]


def score_table(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives at each distinct score: what every ranking metric needs, however many rows there are."""
    w = F.lit(1.0) if weight is None else weight
    return df.where("label is not null and prob is not null").groupBy(*by, "prob").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("neg"))


def ranked(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """The score table with pos_before, neg_before (at smaller scores), pos_all and neg_all."""
    return cumulated(score_table(df, by, weight), by, "prob", ["pos", "neg"], score_part(F.col("prob")))


def auroc(df: DataFrame, by: list[str] = BY, weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties averaged; null where there is one class only. Pairs within a part of the scores are counted
    there, pairs of parts from the parts' sums, so no task orders a whole group."""
    inside = Window.partitionBy(*by, "_part").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    below = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    t = score_table(df, by, weight).withColumn("_part", score_part(F.col("prob"))).withColumn("_b", below("neg", inside))
    parts = t.groupBy(*by, "_part").agg(F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    p, n = F.sum("_p"), F.sum("_n")
    return parts.withColumn("_b", below("_n", earlier)).groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum(F.col("_u") + F.col("_p") * F.col("_b")) / (p * n)).alias("auroc"))


def auprc(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """Average precision; null where there is one class only."""
    p, n = F.sum("pos"), F.sum("neg")
    tp, fp = F.col("pos_all") - F.col("pos_before"), F.col("neg_all") - F.col("neg_before")
    return ranked(df, by).groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * tp / (tp + fp)) / p).alias("auprc"))


def ece(df: DataFrame, by: list[str] = BY, bins: int = 9) -> DataFrame:
    """Expected calibration error over half-open bins of equal width; a score of 1 is in none, but counts among the rows."""
    rows = df.withColumn("_bin", F.floor(F.col("prob") * bins))
    per = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_y"), F.sum("prob").alias("_p"))
    error = F.sum(F.when(F.col("_bin") < bins, F.abs(F.col("_y") - F.col("_p"))).otherwise(0.0))
    return per.groupBy(*by).agg((error / F.sum("_n")).alias("ece"))


#: Chances that a Poisson(1) draw is at most 0, 1, ... 7; beyond it is taken as 8.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def poisson_weights(hashes: np.ndarray, n: int) -> np.ndarray:
    """A row's weight, Poisson(1), in each of n replicates: a mixing of its hash and the replicate's number."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    w = np.zeros(u.shape)
    for most in _AT_MOST:
        w += u >= most
    return w


class _Sweep:
    """Weights of a part's rows, from the highest score down, in all replicates at once: positives p, negatives n, the sum q of
    scores, the pairs u of a negative below a positive (ties half) and the sum a of positives times the precision at their score.
    Scores above the part count from the start (p0, n0)."""

    def __init__(self, n: int, start: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.p0, self.n0 = start or (np.zeros(n), np.zeros(n))
        self.p, self.n, self.q, self.u, self.a, self.same_p, self.same_n = (np.zeros(n) for _ in range(7))
        self.score: float | None = None

    def _close(self, pos: np.ndarray, neg: np.ndarray) -> None:
        """Scores that are complete, a row each."""
        p, n = self.p0 + self.p + np.cumsum(pos, 0), self.n0 + self.n + np.cumsum(neg, 0)
        self.u += (neg * (p - pos / 2)).sum(0)
        self.a += (pos * p / np.maximum(p + n, 1)).sum(0)
        self.p += pos.sum(0)
        self.n += neg.sum(0)

    def add(self, scores: np.ndarray, labels: np.ndarray, w: np.ndarray) -> None:
        self.q += scores @ w
        starts = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        pos, neg = (np.add.reduceat(w * (labels == y)[:, None], starts, axis=0) for y in (1, 0))
        if self.score == scores[0]:
            pos[0] += self.same_p
            neg[0] += self.same_n
        else:
            self._close(self.same_p[None], self.same_n[None])
        self._close(pos[:-1], neg[:-1])
        self.same_p, self.same_n, self.score = pos[-1], neg[-1], scores[-1]

    def end(self) -> list[np.ndarray]:
        self._close(self.same_p[None], self.same_n[None])
        return [self.p, self.n, self.q, self.u, self.a]


def _swept(rows: DataFrame, by: list[str], n: int, starts: DataFrame | None = None) -> DataFrame:
    """rows (by, _part, _h, label 0/1, prob), maybe with starts (by, _part, p0, n0: arrays): by, _part, replicate and the sums of
    _Sweep. Rows move once and are multiplied by the replicates only as arrays of 256 rows in their part's task, which reads its
    part as a stream; what comes out is parts times replicates, however many rows there are."""
    keys = [*by, "_part"]
    both = rows.withColumns({"p0": F.lit(None).cast("array<double>"), "n0": F.lit(None).cast("array<double>")})
    if starts is not None:
        both = both.unionByName(starts, allowMissingColumns=True)
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_k")
    filled = (F.coalesce(c, F.lit(0)).alias(c) for c in ("_h", "label", "prob"))  # pandas would make null hashes' column doubles
    both = both.select(name, *filled, "p0", "n0").repartition("_k").sortWithinPartitions("_k", F.col("p0").isNull(), F.desc("prob"))

    def sweep(batches):
        key, part = None, None
        for b in batches:
            names = b["_k"].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if names[lo] != key:
                    if part is not None:
                        yield pd.DataFrame({"_k": [key], "s": [part.end()]})
                    key, part = names[lo], None
                if b["p0"].iat[lo] is not None:
                    part, lo = _Sweep(n, (np.array(b["p0"].iat[lo]), np.array(b["n0"].iat[lo]))), lo + 1
                part = part or _Sweep(n, None)
                for i in range(lo, hi, 256):
                    c = b.iloc[i : min(hi, i + 256)]
                    part.add(c["prob"].to_numpy(float), c["label"].to_numpy(float), poisson_weights(c["_h"].to_numpy(np.int64), n))
        if part is not None:
            yield pd.DataFrame({"_k": [key], "s": [part.end()]})

    kinds = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keys])
    out = both.mapInPandas(sweep, "_k string, s array<array<double>>").withColumn("_k", F.from_json("_k", kinds))
    return out.select("_k.*", F.posexplode(F.arrays_zip(*(F.col("s")[i].alias(c) for i, c in enumerate("pnqua")))).alias("replicate", "s")).select(*keys, "replicate", "s.*")


def bootstrap(df: DataFrame, key: str, metric: str = "auroc", n: int = 1000, seed: int = 0, by: list[str] = BY) -> DataFrame:
    """auroc, auprc or ece (of 9 bins) of n bootstrap replicates: by, replicate, value (null where a replicate has one class only).
    A row's weight in each is Poisson(1) from a hash of seed, replicate and key (null keys are one), so that models get the same
    draws, all rows of a key the same weight, and no rows meet in one place. Rows without label or score don't count; empty: empty."""
    part = F.floor(F.col("prob") * 9).cast("int") if metric == "ece" else score_part(F.col("prob"), 1 / 8)
    rows = df.where("label is not null and prob is not null").select(*by, part.alias("_part"), drawn(key, seed).alias("_h"), F.col("label").cast("int").alias("label"), F.col("prob").cast("double").alias("prob"))
    sums = _swept(rows, by, n)
    p, m = F.sum("p"), F.sum("n")
    if metric == "ece":
        error = F.sum(F.when(F.col("_part") < 9, F.abs(F.col("p") - F.col("q"))).otherwise(0.0))
        return sums.groupBy(*by, "replicate").agg(F.when(p + m > 0, error / (p + m)).alias("value"))
    above = Window.partitionBy(*by, "replicate").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = sums.withColumns({f"{c}0": F.coalesce(F.sum(c).over(above), F.lit(0.0)) for c in "pn"})
    if metric == "auroc":
        return sums.groupBy(*by, "replicate").agg(F.when((p > 0) & (m > 0), F.sum(F.col("u") + F.col("n") * F.col("p0")) / (p * m)).alias("value"))
    if metric != "auprc":
        raise ValueError(f"no such metric: {metric}")
    starts = sums.groupBy(*by, "_part").agg(F.sort_array(F.collect_list(F.struct("replicate", "p0", "n0"))).alias("_s"))  # n elements
    sums = _swept(rows, by, n, starts.select(*by, "_part", F.col("_s.p0").alias("p0"), F.col("_s.n0").alias("n0")))
    return sums.groupBy(*by, "replicate").agg(F.when((p > 0) & (m > 0), F.sum("a") / p).alias("value"))


def bootstrap_ci(df: DataFrame, key: str, base: str | None = None, n: int = 1000, seed: int = 0, metric: str = "auroc") -> DataFrame:
    """2.5 and 97.5 percentiles of each model's metric over the replicates, or of its difference to a base model on the same draws."""
    draws, value = bootstrap(df, key, metric, n, seed), F.col("value")
    if base is not None:
        draws = written(draws)
        other = draws.where(F.col("model") == base).select("task", "replicate", F.col("value").alias("_base"))
        draws, value = draws.join(other, ["task", "replicate"]), F.col("value") - F.col("_base")
    return draws.withColumn("v", value).groupBy(*BY).agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.025)").alias("low"), F.expr("percentile(v, 0.975)").alias("high"))


def assert_aligned(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of either model that the other has not with the same patient, task, time and label: none if they are aligned."""
    key = [c for c in ("task", "patient_id", "time", "label") if c in df.columns]
    n = lambda m: F.count(F.when(F.col("model") == m, 1))
    return df.where(F.col("model").isin(a, b)).groupBy(*key).agg(n(a).alias("_a"), n(b).alias("_b")).where("_a <> _b").select(*key)


def subsets(models: list[str]) -> list[tuple[str, ...]]:
    """All sets of two and more models."""
    return [c for n in range(2, len(models) + 1) for c in itertools.combinations(models, n)]


def logits(df: DataFrame, models: list[str]) -> DataFrame:
    """(task, patient_id, label, x: the logits of the models in order, null where one says nothing)."""
    cells = [F.max(F.when(F.col("model") == m, logit(F.col("prob")))) for m in models]
    return df.groupBy("task", "patient_id").agg(F.max("label").alias("label"), F.array(*cells).alias("x"))


def of_subsets(wide: DataFrame, sets: list[tuple[int, ...]], models: list[str]) -> DataFrame:
    """wide (task, patient_id, label, x) for each set of models: model (A+B), set (its number), x with 0 for the others; rows that a
    model of the set says nothing about go."""
    each = [F.struct(F.lit("+".join(models[i] for i in s)).alias("model"), F.lit(k).alias("set"), F.array(*(F.col("x")[i] if i in s else F.lit(0.0) for i in range(len(models)))).alias("x")) for k, s in enumerate(sets)]
    rows = wide.select("task", "patient_id", "label", F.explode(F.array(*each)).alias("e")).select("task", "patient_id", "label", "e.*")
    return rows.where(~F.exists("x", lambda v: v.isNull()))


#: Newton steps at most, the mean of the likelihood equations at which they end, and the mean variance of labels below which
#: the classes are parted: then larger weights are always likelier.
STEPS, CLOSE, PARTED = 40, 1e-10, 1e-8


def weighed(rows: DataFrame, weights: dict[tuple, Sequence[float]]) -> DataFrame:
    """rows (task, set) with _w, their weights; null where there are none."""
    schema = T.StructType([T.StructField("_task", rows.schema["task"].dataType), T.StructField("_set", T.IntegerType()), T.StructField("_w", T.ArrayType(T.DoubleType()))])
    table = rows.sparkSession.createDataFrame([(*k, [float(v) for v in w]) for k, w in weights.items()], schema)  # a row a task and set
    return rows.join(F.broadcast(table), F.col("task").eqNullSafe(F.col("_task")) & (F.col("set") == F.col("_set")), "left")


def weighted(x: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, "_w", lambda a, w: a * w), F.lit(0.0), lambda total, v: total + v)


def fused_weights(rows: DataFrame, sets: list[tuple[int, ...]], width: int) -> dict[tuple, list[float]]:
    """(task, set): intercept and weights of the logistic regression of label on x, for all of them at once.

    A step is one aggregation for all tasks and sets, which gives the likelihood, its gradient and its curvature; tables of tasks
    times sets, a few numbers each, are all that reaches the driver. A step that lowers a likelihood is halved. Equal weights
    stand where the labels have one class or the equations aren't met in STEPS steps (as the classes can be parted).
    """
    n = width + 1
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = written(rows.select("task", "set", F.col("label").cast("double").alias("label"), F.concat(F.array(F.lit(1.0)), "x").alias("x")))
    groups = {(r["task"], r["set"]): (r.n, r.p) for r in rows.groupBy("task", "set").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    at = {k: np.zeros(n) for k, (count, p) in groups.items() if 0 < p < count}
    step, best = {k: np.zeros(n) for k in at}, dict.fromkeys(at, -math.inf)
    done: dict[tuple, list[float]] = {}
    for _ in range(STEPS):
        if not at:
            break
        met = weighed(rows, {k: at[k] + step[k] for k in at}).where("_w is not null").select("task", "set", "label", "x", weighted("x").alias("z"))
        met = met.withColumn("p", expit(F.col("z")))
        fit = F.col("label") * F.col("z") - F.greatest(F.col("z"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("z")))
        sums = [F.sum((F.col("label") - F.col("p")) * F.col("x")[i]).alias(f"g{i}") for i in range(n)] + [F.sum(F.col("p") * (1 - F.col("p")) * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i, j in pairs]
        for r in met.groupBy("task", "set").agg(F.sum(fit).alias("fit"), *sums).collect():
            k = (r["task"], r["set"])
            if not r.fit >= best[k] - 1e-9 * abs(r.fit):
                step[k] = step[k] / 2
                continue
            at[k], best[k] = at[k] + step[k], r.fit
            used = [0, *(i + 1 for i in sets[k[1]])]
            g = np.array([r[f"g{i}"] for i in used])
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in used] for i in used])
            if np.abs(g).max() <= CLOSE * groups[k][0]:
                ended = at.pop(k)
                if h[0, 0] > PARTED * groups[k][0]:
                    done[k] = [float(v) for v in ended]
                continue
            step[k] = np.zeros(n)
            step[k][used] = np.linalg.lstsq(h, g, rcond=None)[0]
    return {k: done.get(k) or [0.0, *(1 / len(sets[k[1]]) if i in sets[k[1]] else 0.0 for i in range(width))] for k in groups}


def fuse_sets(validation: DataFrame, test: DataFrame, models: list[str], sets: list[tuple[int, ...]]) -> DataFrame:
    """Late fusion for each task and set of models: an unpenalised logistic regression on the models' validation logits, applied to
    test: model, task, patient_id, label, prob. A task without validation rows has equal weights."""
    fits = of_subsets(logits(validation, models), sets, models).where("label is not null")
    rows = of_subsets(logits(test, models), sets, models)
    equal = F.element_at(F.array(*(F.array(F.lit(0.0), *(F.lit(1 / len(s) if i in s else 0.0) for i in range(len(models)))) for s in sets)), F.col("set") + 1)
    rows = weighed(rows, fused_weights(fits, sets, len(models))).withColumn("_w", F.coalesce("_w", equal))
    return rows.select("model", "task", "patient_id", "label", expit(weighted(F.concat(F.array(F.lit(1.0)), "x"))).alias("prob"))


def fuse(validation: DataFrame, test: DataFrame, models: list[str]) -> DataFrame:
    """Late fusion of the models of one task; equal weights where the labels have one class or the classes can be parted. Returns
    test's patient_id, label and prob."""
    one = lambda df: df.withColumn("task", F.lit(""))
    return fuse_sets(one(validation), one(test), models, [tuple(range(len(models)))]).select("patient_id", "label", "prob")


def fuse_subsets(validation: DataFrame, test: DataFrame, models: list[str]) -> DataFrame:
    """fuse over all sets of two and more models, for each task: predictions of models named after their sets (A+B). All tasks and
    sets are fit in the same jobs."""
    place = {m: i for i, m in enumerate(models)}
    return fuse_sets(validation.where("task is not null"), test.where("task is not null"), models, [tuple(place[m] for m in s) for s in subsets(models)])


def best_models(metrics: DataFrame, metric: str, singles: list[str], lower: bool = False) -> DataFrame:
    """Best single and best overall model of each task, ties by name; lower: the least is best."""
    v = F.col(metric) if lower else -F.col(metric)
    pick = lambda ok: F.min(F.when(ok & F.col(metric).isNotNull(), F.struct(v.alias("v"), "model"))).getField("model")
    return metrics.groupBy("task").agg(pick(F.col("model").isin(singles)).alias("best_single"), pick(F.lit(True)).alias("best"))


def score_as_model(scores: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """A score (patient_id, score) as predictions: prob is its expit."""
    return labels.join(scores, "patient_id").select(F.lit(name).alias("model"), "task", "patient_id", "label", expit(F.col("score").cast("double")).alias("prob"))


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] = BY) -> DataFrame:
    return df.where("label is not null").withColumn("pred", (F.col("prob") >= threshold).cast("int")).groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _cells(threshold: float | Column) -> dict[str, Column]:
    hit, y = F.col("prob") >= threshold, F.col("label") == 1
    n = lambda c: F.count(F.when(c, 1))
    return {"tp": n(hit & y), "fp": n(hit & ~y), "fn": n(~hit & y), "tn": n(~hit & ~y)}


def sens_spec(df: DataFrame, threshold: float | Column = 0.5, by: list[str] = BY) -> DataFrame:
    """Sensitivity and specificity at a threshold (score at or above it: positive); null without rows of the class."""
    c = _cells(threshold)
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b))
    return df.groupBy(*by).agg(ratio(c["tp"], c["fn"]).alias("sensitivity"), ratio(c["tn"], c["fp"]).alias("specificity"))


def roc_curve(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """threshold, fpr and tpr at each distinct score."""
    rate = lambda c: (F.col(f"{c}_all") - F.col(f"{c}_before")) / F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_all"))
    return ranked(df, by).select(*by, F.col("prob").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def youden(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """The threshold with the largest tpr - fpr, ties to the higher one, within 0..1."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    best = roc_curve(df, by).groupBy(*by).agg(F.max(F.struct(j.alias("j"), "threshold")).alias("_b"))
    return best.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_b.threshold"))).alias("threshold"))


def prob_histogram(df: DataFrame, bins: int = 29, by: list[str] = BY) -> DataFrame:
    """Rows of each class in bins of equal width over 0..1, the last closed."""
    b = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy(*by, "label", "bin").agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, threshold: float = 0.5, by: list[str] = BY) -> DataFrame:
    """precision, recall, F1 and support of each class; 0 where a denominator is."""
    c = confusion(df, threshold, by)
    rows = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    agg = rows.groupBy(*by, F.col("k").alias("class")).agg(n((F.col("label") == F.col("k")) & (F.col("pred") == F.col("k"))).alias("tp"), n((F.col("label") != F.col("k")) & (F.col("pred") == F.col("k"))).alias("fp"), n((F.col("label") == F.col("k")) & (F.col("pred") != F.col("k"))).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return agg.select(*by, "class", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def cv_summary(df: DataFrame, by: list[str] = BY) -> DataFrame:
    """Pooled out-of-fold AUROC, and mean and population SD of the folds' (df: fold too)."""
    folds = auroc(df, [*by, "fold"]).groupBy(*by).agg(F.avg("auroc").alias("fold_mean"), F.stddev_pop("auroc").alias("fold_sd"))
    return auroc(df, by).withColumnRenamed("auroc", "pooled").join(folds, by)


def subgroup_interaction(df: DataFrame, group: str, a: str, b: str, key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """How much more model a loses than b from group false to true: the drops, their difference, its bootstrap interval, and the
    share of replicates in which it isn't above 0."""
    def drops(draws: DataFrame, by: list[str]) -> DataFrame:
        cell = lambda m, g: F.max(F.when((F.col("model") == m) & (F.col(group) == g), F.col("value")))
        return draws.groupBy(*by).agg((cell(a, False) - cell(a, True)).alias("drop_a"), (cell(b, False) - cell(b, True)).alias("drop_b")).withColumn("interaction", F.col("drop_a") - F.col("drop_b"))

    point = drops(auroc(df, ["task", "model", group]).withColumnRenamed("auroc", "value"), ["task"])
    boot = drops(bootstrap(df, key, "auroc", n, seed, ["task", "model", group]), ["task", "replicate"]).where("interaction is not null")
    ci = boot.groupBy("task").agg(F.expr("percentile(interaction, 0.025)").alias("low"), F.expr("percentile(interaction, 0.975)").alias("high"), F.avg((F.col("interaction") <= 0).cast("int")).alias("p"))
    return point.join(ci, "task")


def paired_auc_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """AUROC of two models on the same rows and a z test of their difference by the jackknife: a row's leave-one-out AUROC comes
    from its placement (the share of the other class on its right side), so nothing is computed anew for each row."""
    def placed(m: str) -> DataFrame:
        rows = df.where((F.col("model") == m) & F.col("label").isNotNull())
        t = ranked(rows, ["task"]).withColumnsRenamed({"pos_all": "P", "neg_all": "N"})
        t = t.withColumns({"wins": F.col("neg_before") + F.col("neg") / 2, "losses": F.col("P") - F.col("pos_before") - F.col("pos") / 2})
        sums = t.groupBy("task").agg(F.sum(F.col("pos") * F.col("wins")).alias("sum"))
        t = t.select("task", "prob", "wins", "losses", "P", "N").join(sums, "task")
        left = F.when(F.col("label") == 1, (F.col("sum") - F.col("wins")) / ((F.col("P") - 1) * F.col("N"))).otherwise((F.col("sum") - F.col("losses")) / (F.col("P") * (F.col("N") - 1)))
        return rows.join(t, ["task", "prob"]).select("task", "patient_id", left.alias(f"loo_{m}"), (F.col("sum") / (F.col("P") * F.col("N"))).alias(f"auc_{m}"))

    x = placed(a).withColumnsRenamed({f"loo_{a}": "la", f"auc_{a}": "auc_a"}).join(placed(b).withColumnsRenamed({f"loo_{b}": "lb", f"auc_{b}": "auc_b"}), ["task", "patient_id"])
    n = F.count(F.lit(1))
    se = F.sqrt(F.greatest(F.var_pop(F.col("la") - F.col("lb")) * (n - 1), F.lit(1e-12)))
    out = x.groupBy("task").agg(F.max("auc_a").alias("auc_a"), F.max("auc_b").alias("auc_b"), se.alias("se"))
    return out.withColumn("diff", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.col("diff") / F.col("se"))


def margin_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mann-Whitney U that wrong predictions of a lie farther from 0.5 than those of b: U, z with tie correction (normal
    approximation), p (of that hypothesis, with the correction for continuity), and the mean margins."""
    wrong = df.where(((F.col("prob") >= 0.5).cast("int") != F.col("label")) & F.col("model").isin(a, b)).withColumn("margin", F.abs(F.col("prob") - 0.5))
    t = wrong.groupBy("margin").agg(F.count(F.when(F.col("model") == a, 1)).alias("na"), F.count(F.when(F.col("model") == b, 1)).alias("nb"))
    t = cumulated(t, [], "margin", ["nb"], score_part(F.col("margin"))).withColumn("_t", F.col("na") + F.col("nb"))
    s = t.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("na") * (F.col("nb_before") + F.col("nb") / 2)).alias("u"), F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("ties"), (F.sum(F.col("margin") * F.col("na")) / F.sum("na")).alias("mean_a"), (F.sum(F.col("margin") * F.col("nb")) / F.sum("nb")).alias("mean_b"))
    n = F.col("n_a") + F.col("n_b")
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("n_a", "n_b", "mean_a", "mean_b", "u", ((F.col("u") - F.col("n_a") * F.col("n_b") / 2) / sd).alias("z"), above((F.col("u") - F.col("n_a") * F.col("n_b") / 2 - 0.5) / sd).alias("p"))


#: A polynomial for the complementary error function, whose relative error is below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def above(z: Column) -> Column:
    """The probability that a standard normal number is greater than z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(0.0)
    for c in reversed(ERFC):
        power = power * t + c
    tail = t * F.exp(power - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def prevalence_shift(df: DataFrame, prevalence: float, threshold: float = 0.5, by: list[str] = BY) -> DataFrame:
    """Predictive values as they are, and at another prevalence by Bayes' rule."""
    t = df.groupBy(*by).agg(*(c.alias(k) for k, c in _cells(threshold).items()))
    ratio = lambda x, y: F.when(y != 0, x / y)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    t = t.withColumns({"sens": ratio(tp, tp + fn), "spec": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn)})
    s, c, p = F.col("sens"), F.col("spec"), prevalence
    return t.select(*by, "ppv", "npv", ratio(s * p, s * p + (1 - c) * (1 - p)).alias("ppv_shifted"), ratio(c * (1 - p), c * (1 - p) + (1 - s) * p).alias("npv_shifted"))


def compare_published(metrics: DataFrame, published: DataFrame, value: str) -> DataFrame:
    """Difference of each task to its published value, and its mean over tasks."""
    t = metrics.join(published.select("task", F.col(value).alias("_p")), "task").withColumn("difference", F.col(value) - F.col("_p"))
    return t.withColumn("mean_difference", F.avg("difference").over(Window.partitionBy())).drop("_p")


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile, by bisection of the integral of its density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def upto(x: float, n: int = 2000) -> float:
        h = x / n
        f = lambda t: (1 + t * t / df) ** (-(df + 1) / 2)
        return 0.5 + c * h / 3 * (f(0) + f(x) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < p else (low, mid)
    return (low + high) / 2


def paired_delta(df: DataFrame, a: str, b: str, confidence: float = 0.95) -> DataFrame:
    """One row: n, mean of a - b over the n tasks that have both, and the ends of its t interval (null below two tasks). Only the
    count comes to the driver, for the quantile."""
    both = df.select((F.col(f"`{a}`") - F.col(f"`{b}`")).alias("_d")).where("_d is not null")
    n = both.count()
    half = F.lit(t_quantile(0.5 + confidence / 2, n - 1) if n > 1 else None).cast("double") * F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), (F.avg("_d") - half).alias("low"), (F.avg("_d") + half).alias("high"))
