"""Models over feature tables, trained by Spark's own library."""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import written
from . import boosting, logistic
from .evaluate import auroc
from .splits import fold_role, own_folds

#: Depths (0: no bound), learning rates and leaves that the surveyed job searches, and its rounds.
DEPTHS, RATES, LEAVES, ROUNDS = (3, 6, 0), (0.02, 0.1, 0.5), (10, 25, 100), 100

def tree_grid() -> list[dict]:
    """All 27 combinations of the surveyed grid."""
    return [{"depth": d, "rate": r, "leaves": n} for d in DEPTHS for r in RATES for n in LEAVES]


def _predictions(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prob", vector_to_array("probability")[1])


def _auc(df: DataFrame) -> float:
    row = auroc(df.withColumn("_all", F.lit(1)), ["_all"]).first()
    return row["auroc"] if row is not None and row["auroc"] is not None else float("nan")


def _searched(df: DataFrame, roles: list[Column], grid: list[dict], rounds: int) -> tuple[DataFrame, list[tuple[dict, float]]]:
    """(df with prob: an array with what the best model of each set of roles says; those models' points of the grid and AUROC on
    the set's valid rows). Of equal points the first. All models are trained in the same passes over df."""
    kept = written(df.withColumn("_row", F.monotonically_increasing_id()))
    used = lambda r: F.lpad(F.when(F.col("label").isNull(), boosting.TEST).otherwise(r).cast("string"), 2, "0")
    rows = kept.select("_row", F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"), F.unhex(F.concat(*map(used, roles))).alias("_roles"), vector_to_array("features").alias("x"))
    rows, width = boosting.binned(rows, "x")
    rows = written(rows)
    models = [boosting.Model(s, p["depth"], p["rate"], p["leaves"]) for s in range(len(roles)) for p in grid]
    state = boosting.boost(rows, width, models, rounds)
    said = written(boosting.probabilities(state, df.sparkSession))
    state.unpersist()
    own = F.array_compact(F.array(*(F.when(F.substring("_roles", s + 1, 1) == F.lit(bytes([boosting.VALID])), s) for s in range(len(roles)))))
    each = rows.select("label", "_bins", F.explode(own).alias("_set")).join(said, "_bins")
    each = each.select("label", "_set", F.posexplode(F.slice("probs", F.col("_set") * len(grid) + 1, len(grid))).alias("_point", "prob"))
    each = each.select("label", (F.col("_set") * len(grid) + F.col("_point")).alias("model"), "prob")
    scores = {r.model: r.auroc for r in auroc(each, ["model"]).collect()}
    first = [max(range(s * len(grid), (s + 1) * len(grid)), key=lambda m: (-1.0 if scores.get(m) is None else scores[m], -m)) for s in range(len(roles))]
    best = F.array(*(F.element_at("probs", m + 1) for m in first))
    found = kept.join(rows.select("_row", "_bins").join(said.select("_bins", best.alias("prob")), "_bins").drop("_bins"), "_row").drop("_row")
    return found, [(grid[m % len(grid)], float("nan") if scores.get(m) is None else scores[m]) for m in first]


def _role(split: Column) -> Column:
    return F.when(split == "train", boosting.TRAIN).when(split == "valid", boosting.VALID).otherwise(boosting.TEST)


def train_trees(df: DataFrame, grid: list[dict] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, dict, float]:
    """Boosted trees on train (features: vector, label 0/1, split), the grid's best by AUROC on valid: (all rows with prob, its
    point, that AUROC). grid: points of depth (levels; 0: no bound), rate and leaves, which both bound a tree that grows best
    leaf first. Rows without a label train nothing and are predicted; without any train rows all are 0.5; empty: empty."""
    found, ((point, score),) = _searched(df, [_role(F.col("split"))], grid or tree_grid(), rounds)
    return found.withColumn("prob", F.element_at("prob", 1)), point, score


def train_trees_cv(df: DataFrame, key: str, k: int = 5, grid: list[dict] | None = None, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Out-of-fold predictions: every row once, from the fold in which its patient is tested, with the point that is best on the
    next fold. The models of all folds and points grow in the same passes. Rows without a key train in all folds and have no
    prediction."""
    rows = own_folds(df.drop("split"), key, k, seed)
    roles = [fold_role(F.col("fold"), F.lit(f), k) for f in range(k)]
    found, _ = _searched(rows, [_role(r) for r in roles], grid or tree_grid(), rounds)
    return found.where("fold is not null").withColumn("split", F.lit("test")).withColumn("prob", F.get("prob", F.col("fold")))


#: The surveyed strengths: 20 from 10 to 1e-5, and none.
STRENGTHS = (*(10.0 ** (1 - 6 * i / 19) for i in range(20)), 0.0)


def linear_probe(df: DataFrame, grid: list[float] | None = None) -> tuple[DataFrame, float, float]:
    """Logistic regression of train with the L2 strength that has the best AUROC on valid (the first of equals): (all rows with
    prob, that strength, that AUROC); warns if it is an end of the grid, by default STRENGTHS. All strengths are fit and scored in
    the same passes. Rows without a label train nothing; without train rows all are 0.5; empty: empty."""
    grid = list(grid or STRENGTHS)
    kept = written(df)
    weights = logistic.path(kept.where("split = 'train'"), grid)
    if not weights.shape[1]:
        return kept.withColumn("prob", F.lit(0.5)), grid[0], float("nan")
    said = logistic.probabilities(kept, weights)
    each = said.where("split = 'valid'").select("label", F.posexplode("probs").alias("k", "prob"))
    scores = {r.k: r.auroc for r in auroc(each, ["k"]).collect() if r.auroc is not None}
    best = max(range(len(grid)), key=lambda k: (scores.get(k, -1.0), -k))
    if best in (0, len(grid) - 1):
        warnings.warn(f"the best L2 strength, {grid[best]}, is an end of the grid", stacklevel=2)
    return said.withColumn("prob", F.element_at("probs", best + 1)).drop("probs"), grid[best], scores.get(best, float("nan"))


def quality_probe(df: DataFrame) -> tuple[DataFrame, float]:
    """Pooled vectors standardised by train and a logistic regression on them: (all rows with prob, AUROC on test)."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(df.where("split = 'train'"))
    scaled = scaler.transform(df).drop("features").withColumnRenamed("scaled", "features")
    out = _predictions(LogisticRegression(regParam=0.0).fit(scaled.where("split = 'train'")), scaled)
    return out, _auc(out.where("split = 'test'"))
