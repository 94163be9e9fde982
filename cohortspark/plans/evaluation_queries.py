"""Queries of evaluation and models over prediction tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluate as E
from ..operators import logistic
from ..operators import models as M
from ..operators import series as S
from . import bindings as B
from .registry import query, rounded

P = B.PREDICTIONS
_AUC = "SELECT p.model, p.task, avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0.0 END) AS auroc FROM preds p JOIN preds n ON p.model = n.model AND p.task = n.task WHERE p.label = 1 AND n.label = 0 GROUP BY 1, 2"
_MET = f"{P}, auc AS ({_AUC})"


@query("SELECT model, task, round(auroc, 6) AS auroc FROM auc", _MET)
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.auroc(B.predictions(spark, d)), "auroc")


@query("SELECT model, task, round(sum(pos * tp / al) / sum(pos), 6) AS auprc FROM (SELECT model, task, pos, sum(pos) OVER w AS tp, sum(al) OVER w AS al FROM (SELECT model, task, prob, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS al FROM preds GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY model, task ORDER BY prob DESC)) GROUP BY 1, 2", P)
def auprc(spark, d):
    return rounded(E.auprc(B.predictions(spark, d)), "auprc")


@query("SELECT model, task, round(sum(CASE WHEN bin < 9 THEN abs(y - p) ELSE 0 END) / sum(n), 6) AS ece FROM (SELECT model, task, floor(prob * 9) AS bin, sum(label) AS y, sum(prob) AS p, count(*) AS n FROM preds GROUP BY 1, 2, 3) GROUP BY 1, 2", P)
def ece(spark, d):
    return rounded(E.ece(B.predictions(spark, d)), "ece")


@query("SELECT model, task, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity FROM cells", f"{P}, cells AS (SELECT model, task, CAST(count(*) FILTER (WHERE prob >= 0.3 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE prob >= 0.3 AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE prob < 0.3 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE prob < 0.3 AND label = 0) AS DOUBLE) AS tn FROM preds GROUP BY 1, 2)")
def sens_spec(spark, d):
    return rounded(E.sens_spec(B.predictions(spark, d), 0.3), "sensitivity", "specificity")


_ROC = "roc AS (SELECT model, task, prob AS threshold, sum(neg) OVER w / sum(neg) OVER a AS fpr, sum(pos) OVER w / sum(pos) OVER a AS tpr FROM (SELECT model, task, prob, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg FROM preds GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY model, task ORDER BY prob DESC), a AS (PARTITION BY model, task))"


@query("SELECT model, task, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc", f"{P}, {_ROC}")
def roc_curve(spark, d):
    return rounded(E.roc_curve(B.predictions(spark, d)), "threshold", "fpr", "tpr")


@query("SELECT model, task, round(max(threshold), 6) AS threshold FROM (SELECT *, rank() OVER (PARTITION BY model, task ORDER BY round(tpr - fpr, 12) DESC) AS r FROM roc) WHERE r = 1 GROUP BY 1, 2", f"{P}, {_ROC}")
def youden(spark, d):
    return rounded(E.youden(B.predictions(spark, d)), "threshold")


@query("SELECT model, task, label, CAST(prob >= 0.5 AS INT) AS pred, count(*) AS n FROM preds GROUP BY ALL", P)
def confusion(spark, d):
    return E.confusion(B.predictions(spark, d))


@query("SELECT model, task, label, CAST(least(28, floor(prob * 29)) AS INT) AS bin, count(*) AS n FROM preds GROUP BY ALL", P)
def prob_histogram(spark, d):
    return E.prob_histogram(B.predictions(spark, d))


@query("SELECT model, task, k AS class, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1, tp + fn AS support FROM (SELECT model, task, k, count(*) FILTER (WHERE label = k AND pred = k) AS tp, count(*) FILTER (WHERE label <> k AND pred = k) AS fp, count(*) FILTER (WHERE label = k AND pred <> k) AS fn FROM (SELECT *, CAST(prob >= 0.5 AS INT) AS pred FROM preds), (VALUES (0), (1)) AS t(k) GROUP BY 1, 2, 3)", P)
def class_report(spark, d):
    return rounded(E.class_report(B.predictions(spark, d)), "precision", "recall", "f1")


@query("SELECT model, task, round(pooled, 6) AS pooled, round(fold_mean, 6) AS fold_mean, round(fold_sd, 6) AS fold_sd FROM (SELECT model, task, auroc AS pooled FROM auc) JOIN (SELECT model, task, avg(a) AS fold_mean, stddev_pop(a) AS fold_sd FROM (SELECT p.model, p.task, p.patient_id % 3 AS fold, avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0.0 END) AS a FROM preds p JOIN preds n ON p.model = n.model AND p.task = n.task AND p.patient_id % 3 = n.patient_id % 3 WHERE p.label = 1 AND n.label = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (model, task)", _MET)
def cv_summary(spark, d):
    return rounded(E.cv_summary(B.predictions(spark, d).withColumn("fold", F.col("patient_id") % 3)), "pooled", "fold_mean", "fold_sd")


@query("SELECT task, arg_max(model, auroc) FILTER (WHERE model = 'B') AS best_single, arg_max(model, auroc) AS best FROM auc GROUP BY 1", _MET)
def best_models(spark, d):
    return E.best_models(E.auroc(B.predictions(spark, d)), "auroc", ["B"])


@query("SELECT model, task, round(auroc, 6) AS auroc, round(auroc - p, 6) AS difference, round(avg(auroc - p) OVER (), 6) AS mean_difference FROM auc JOIN (VALUES ('quality', 0.6), ('toxic', 0.7)) AS t(task, p) USING (task)", _MET)
def compare_published(spark, d):
    published = spark.sql("SELECT task, CAST(auroc AS DOUBLE) AS auroc FROM VALUES ('quality', 0.6), ('toxic', 0.7) AS t(task, auroc)")
    return rounded(E.compare_published(E.auroc(B.predictions(spark, d)), published, "auroc"), "auroc", "difference", "mean_difference")


@query("SELECT model, task, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round(s * 0.2 / (s * 0.2 + (1 - c) * 0.8), 6) AS ppv_shifted, round(c * 0.8 / (c * 0.8 + (1 - s) * 0.2), 6) AS npv_shifted FROM (SELECT *, tp / (tp + fn) AS s, tn / (tn + fp) AS c FROM (SELECT model, task, CAST(count(*) FILTER (WHERE prob >= 0.1 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE prob >= 0.1 AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE prob < 0.1 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE prob < 0.1 AND label = 0) AS DOUBLE) AS tn FROM preds GROUP BY 1, 2))", P)
def prevalence_shift(spark, d):
    return rounded(E.prevalence_shift(B.predictions(spark, d), 0.2, 0.1), "ppv", "npv", "ppv_shifted", "npv_shifted")


@query("SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(u, 6) AS u, round((u - n_a * n_b / 2.0) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - t / ((n_a + n_b) * (n_a + n_b - 1.0)))), 6) AS z, round(0.5 - zc / 6000 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(zc * i / 6000, 2) / 2)) FROM range(6001) AS x(i)) / 3, 5) AS p FROM (SELECT *, (u - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - t / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS zc FROM ties, (SELECT (SELECT count(*) FROM wrong WHERE model = 'A') AS n_a, (SELECT count(*) FROM wrong WHERE model = 'B') AS n_b, (SELECT avg(margin) FROM wrong WHERE model = 'A') AS mean_a, (SELECT avg(margin) FROM wrong WHERE model = 'B') AS mean_b, (SELECT sum(CASE WHEN a.margin > b.margin THEN 1.0 WHEN a.margin = b.margin THEN 0.5 ELSE 0 END) FROM wrong a JOIN wrong b ON a.model = 'A' AND b.model = 'B') AS u))", f"{P}, wrong AS (SELECT model, abs(prob - 0.5) AS margin FROM preds WHERE CAST(prob >= 0.5 AS INT) <> label), ties AS (SELECT sum(pow(t, 3) - t) AS t FROM (SELECT count(*) AS t FROM wrong GROUP BY margin))")
def margin_test(spark, d):
    return rounded(rounded(E.margin_test(B.predictions(spark, d), "A", "B"), "mean_a", "mean_b", "u", "z"), "p", digits=5)


_PLACED = f"{P}, s AS (SELECT *, sum(label) OVER (PARTITION BY model, task) AS np, sum(1 - label) OVER (PARTITION BY model, task) AS nn, sum(1 - label) OVER x AS nle, sum(label) OVER x AS ple, sum(1 - label) OVER e AS neq, sum(label) OVER e AS peq FROM preds WHERE label IS NOT NULL WINDOW x AS (PARTITION BY model, task ORDER BY prob RANGE UNBOUNDED PRECEDING), e AS (PARTITION BY model, task, prob)), w AS (SELECT *, nle - neq / 2.0 AS wins, np - ple + peq / 2.0 AS losses FROM s), t AS (SELECT *, sum(label * wins) OVER (PARTITION BY model, task) AS total FROM w), loo AS (SELECT model, task, patient_id, total / (np * nn) AS auc, CASE WHEN label = 1 THEN (total - wins) / ((np - 1) * nn) ELSE (total - losses) / (np * (nn - 1)) END AS l FROM t)"


@query("SELECT task, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS diff, round(se, 6) AS se, round((auc_a - auc_b) / se, 4) AS z FROM (SELECT task, max(a.auc) AS auc_a, max(b.auc) AS auc_b, sqrt(greatest(var_pop(a.l - b.l) * (count(*) - 1), 1e-12)) AS se FROM (SELECT * FROM loo WHERE model = 'A') a JOIN (SELECT * FROM loo WHERE model = 'B') b USING (task, patient_id) GROUP BY 1)", _PLACED)
def paired_auc_test(spark, d):
    out = rounded(E.paired_auc_test(B.predictions(spark, d), "A", "B").select("task", "auc_a", "auc_b", "diff", "se", "z"), "auc_a", "auc_b", "diff", "se")
    return rounded(out, "z", digits=4)


@query("SELECT task, patient_id, label FROM preds WHERE model = 'A' AND patient_id % 50 = 0", P)
def alignment(spark, d):
    return E.assert_aligned(B.predictions(spark, d).where("not (model = 'B' and patient_id % 50 = 0)"), "A", "B")


@query("SELECT 'score' AS model, task, patient_id, label, round(1 / (1 + exp(-(patient_id % 7))), 6) AS prob FROM preds WHERE model = 'A'", P)
def score_as_model(spark, d):
    p = B.predictions(spark, d).where("model = 'A'")
    scores = p.select("patient_id", (F.col("patient_id") % 7).alias("score")).distinct()
    return rounded(E.score_as_model(scores, p.drop("model", "prob"), "score"), "prob")


@query("SELECT model, task, patient_id, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-q)), 6) AS expit FROM (SELECT model, task, patient_id, greatest(0.01, least(0.99, prob)) AS q FROM preds)", P)
def logits(spark, d):
    q = scalars.clip(F.col("prob"), 0.01, 0.99)
    return rounded(B.predictions(spark, d).select("model", "task", "patient_id", scalars.logit(q).alias("logit"), scalars.expit(q).alias("expit")), "logit", "expit")


@query("SELECT task, CASE WHEN contains(task, 'PE') THEN 'PE' WHEN contains(task, 'mortality') THEN 'Mort' WHEN contains(task, 'readmission') THEN 'Re-ad' ELSE 'PH' END AS category, CASE WHEN contains(task, '12_month') THEN '12 m' WHEN contains(task, '6_month') THEN '6 m' WHEN contains(task, '1_month') THEN '1 m' ELSE 'N/A' END AS horizon FROM (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'PE' WHEN 1 THEN '1_month_mortality' WHEN 2 THEN '6_month_readmission' WHEN 3 THEN '12_month_PH' ELSE '12_month_mortality' END AS task FROM customer)")
def task_names(spark, d):
    k = F.col("c_custkey") % 5
    task = F.when(k == 0, "PE").when(k == 1, "1_month_mortality").when(k == 2, "6_month_readmission").when(k == 3, "12_month_PH").otherwise("12_month_mortality")
    return B.read(spark, d, "customer").select(task.alias("task")).distinct().select("task", scalars.task_category(F.col("task")).alias("category"), scalars.task_horizon(F.col("task")).alias("horizon"))


def _mixed(z: str, factor: int, shift: int) -> str:
    """A step of the mixing of hashes in 64 bits, which SQL does in 128."""
    return f"(xor({z}, {z} >> {shift}) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT"


#: The weights of E.poisson_weights and the metrics of every replicate.
_WEIGHT = " + ".join(f"CAST(u >= CAST('{float(most)!r}' AS DOUBLE) AS INT)" for most in E._AT_MOST)
_DRAWS = f"""{P}, known AS (SELECT * FROM preds WHERE label IS NOT NULL AND prob IS NOT NULL),
    z1 AS (SELECT patient_id, r, (CAST('0x' || substr(md5('0|' || patient_id), 1, 12) AS BIGINT)::UHUGEINT + (r + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM (SELECT DISTINCT patient_id FROM known), range(1000) AS x(r)),
    z2 AS (SELECT patient_id, r, {_mixed("z", 0xBF58476D1CE4E5B9, 30)} AS z FROM z1), z3 AS (SELECT patient_id, r, {_mixed("z", 0x94D049BB133111EB, 27)} AS z FROM z2),
    draws AS MATERIALIZED (SELECT patient_id, r, CAST({_WEIGHT} AS DOUBLE) AS w FROM (SELECT patient_id, r, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM z3)),
    weighed AS MATERIALIZED (SELECT known.*, patient_id % 2 = 0 AS hedged, r, w FROM known JOIN draws USING (patient_id))"""


def _boot(metric: str, by: str = "model, task") -> str:
    if metric == "ece":
        return f"SELECT {by}, r, sum(CASE WHEN bin < 9 THEN abs(y - p) ELSE 0 END) / nullif(sum(n), 0) AS v FROM (SELECT {by}, r, floor(prob * 9) AS bin, sum(w) AS n, sum(w * label) AS y, sum(w * prob) AS p FROM weighed GROUP BY ALL) GROUP BY ALL"
    value = "sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg))" if metric == "auroc" else "sum(pos * tp / greatest(al, 1)) / sum(pos)"
    scores = f"SELECT {by}, r, prob, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM weighed GROUP BY ALL"
    return f"SELECT {by}, r, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {value} END AS v FROM (SELECT *, sum(neg) OVER (PARTITION BY {by}, r ORDER BY prob) AS upto, sum(pos) OVER d AS tp, sum(pos + neg) OVER d AS al FROM ({scores}) WINDOW d AS (PARTITION BY {by}, r ORDER BY prob DESC)) GROUP BY ALL"


_INTERVAL = "round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high"


@query(f"SELECT model, task, {_INTERVAL} FROM ({_boot('auroc')}) GROUP BY ALL", _DRAWS)
def bootstrap_ci(spark, d):
    return rounded(E.bootstrap_ci(B.predictions(spark, d), "patient_id"), "mean", "low", "high")


@query(f"SELECT model, task, metric, {_INTERVAL} FROM (SELECT *, 'auprc' AS metric FROM ({_boot('auprc')}) UNION ALL SELECT *, 'ece' FROM ({_boot('ece')})) GROUP BY ALL", _DRAWS)
def bootstrap_metrics(spark, d):
    """Intervals of average precision and calibration error."""
    p = B.predictions(spark, d)
    one, two = (E.bootstrap_ci(p, "patient_id", metric=m).withColumn("metric", F.lit(m)) for m in ("auprc", "ece"))
    return rounded(one.unionByName(two), "mean", "low", "high")


@query(f"SELECT model, task, {_INTERVAL} FROM (SELECT m.model, m.task, m.v - a.v AS v FROM boot m JOIN boot a ON m.task = a.task AND m.r = a.r WHERE a.model = 'A') GROUP BY ALL", f"{_DRAWS}, boot AS MATERIALIZED ({_boot('auroc')})")
def bootstrap_difference(spark, d):
    return rounded(E.bootstrap_ci(B.predictions(spark, d), "patient_id", base="A"), "mean", "low", "high")


def _drops(rows: str, by: str) -> str:
    cell = lambda m, g: f"max(v) FILTER (WHERE model = '{m}' AND {'' if g else 'NOT '}hedged)"
    return f"SELECT {by}, {cell('A', 0)} - {cell('A', 1)} AS drop_a, {cell('B', 0)} - {cell('B', 1)} AS drop_b FROM {rows} GROUP BY ALL"


_POINT = "SELECT p.model, p.task, p.patient_id % 2 = 0 AS hedged, avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0.0 END) AS v FROM known p JOIN known n ON p.model = n.model AND p.task = n.task AND p.patient_id % 2 = n.patient_id % 2 WHERE p.label = 1 AND n.label = 0 GROUP BY ALL"


@query("SELECT task, round(drop_a, 6) AS drop_a, round(drop_b, 6) AS drop_b, round(drop_a - drop_b, 6) AS interaction, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM point JOIN (SELECT task, quantile_cont(drop_a - drop_b, 0.025) AS low, quantile_cont(drop_a - drop_b, 0.975) AS high, avg(CAST(drop_a - drop_b <= 0 AS INT)) AS p FROM boot WHERE drop_a - drop_b IS NOT NULL GROUP BY 1) USING (task)", f"{_DRAWS}, point AS ({_drops(f'({_POINT})', 'task')}), boot AS ({_drops('(' + _boot('auroc', 'model, task, hedged') + ')', 'task, r')})")
def subgroup_interaction(spark, d):
    p = B.predictions(spark, d).withColumn("hedged", F.col("patient_id") % 2 == 0)
    return rounded(E.subgroup_interaction(p, "hedged", "A", "B", "patient_id"), "drop_a", "drop_b", "interaction", "low", "high", "p")


def _three(spark, d):
    p = B.predictions(spark, d)
    c = p.where("model = 'A'").withColumns({"model": F.lit("C"), "prob": (F.col("patient_id") * 104729 % 997) / 997.0})
    return p.unionByName(c)


@query()
def late_fusion(spark, d):
    p = _three(spark, d)
    return E.fuse_subsets(p.where("patient_id % 2 = 0"), p.where("patient_id % 2 = 1"), ["A", "B", "C"])


@query("SELECT task, model, term, n, CAST(0 AS DOUBLE) AS gradient FROM (SELECT task, count(DISTINCT patient_id) AS n FROM preds WHERE patient_id % 2 = 0 AND label IS NOT NULL GROUP BY task), (VALUES ('A+B', ['1', 'A', 'B']), ('A+C', ['1', 'A', 'C']), ('B+C', ['1', 'B', 'C']), ('A+B+C', ['1', 'A', 'B', 'C'])) AS m(model, terms), unnest(terms) AS t(term)", P)
def fusion_equations(spark, d):
    """The likelihood equations of every fusion at its solution: sums of (label - prob) times each term are 0."""
    p = _three(spark, d).where("patient_id % 2 = 0")
    own = E.logits(p, ["A", "B", "C"]).select("task", "patient_id", "x")
    rows = E.fuse_subsets(p, p, ["A", "B", "C"]).where("label is not null").join(own, ["task", "patient_id"])
    terms = F.array(F.struct(F.lit("1").alias("term"), F.lit(1.0).alias("v")), *(F.struct(F.lit(m).alias("term"), F.col("x")[i].alias("v")) for i, m in enumerate("ABC")))
    rows = rows.select("task", "model", "label", "prob", F.explode(terms).alias("t")).where(F.col("t.term").isin("1") | F.col("model").contains(F.col("t.term")))
    sums = rows.groupBy("task", "model", F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") - F.col("prob")) * F.col("t.v")).alias("gradient"))
    return rounded(sums, "gradient", digits=4)


def _features(spark, d):
    words = F.size(F.split("text", " "))  # numbers are made of the texts before these would be shuffled
    docs = B.read(spark, d, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("a"), (F.length("text") / words).alias("b"))
    docs = docs.join(B.read(spark, d, "labels"), "doc_id")
    df = docs.select(F.col("doc_id").alias("patient_id"), F.col("quality").cast("double").alias("label"), "a", "b", F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "valid").otherwise("test").alias("split"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).drop("a", "b")


@query()
def train_trees(spark, d):
    return M.train_trees(_features(spark, d))[0].select("patient_id", "split", "label", "prob")


@query()
def train_trees_cv(spark, d):
    return M.train_trees_cv(_features(spark, d), "patient_id").select("patient_id", "fold", "label", "prob")


@query()
def linear_probe(spark, d):
    return M.linear_probe(_features(spark, d))[0].select("patient_id", "split", "label", "prob")


@query("SELECT CAST(k AS INT) AS k, term, n, CAST(0 AS DOUBLE) AS gradient FROM range(21) AS x(k), (VALUES (0), (1), (2)) AS t(term), (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 < 3 AND quality IS NOT NULL)")
def probe_gradients(spark, d):
    """The gradient of every strength's objective at its solution, which is 0: (strength, feature or 2: the intercept)."""
    df = _features(spark, d).where("split = 'train' and label is not null")
    weights = logistic.path(df, list(M.STRENGTHS))
    x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    said = logistic.probabilities(df, weights).select("label", x.alias("x"), F.posexplode("probs").alias("k", "p"))
    said = said.select("k", "label", "p", F.posexplode("x").alias("term", "v"))
    sums = said.groupBy("k", "term").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("label")) * F.col("v")).alias("mean"))
    pull = [(k, j, float(s * weights[k, j])) for k, s in enumerate(M.STRENGTHS) for j in range(2)]
    out = sums.join(F.broadcast(spark.createDataFrame(pull, "k int, term int, pull double")), ["k", "term"], "left")
    return rounded(out.select("k", "term", "n", (F.col("mean") + F.coalesce("pull", F.lit(0.0))).alias("gradient")), "gradient")


@query()
def quality_probe(spark, d):
    """Over mean-pooled vectors: every vector's components as slices of a scan of its own block of ids."""
    e = B.read(spark, d, "embeddings")
    scan = F.concat(F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") / 40).cast("long").cast("string"))
    slices = e.select(scan.alias("scan"), F.col("vec_id").alias("slice_idx"), F.col("embedding").alias("vector"))
    pooled = S.pool(slices, "mean").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).value.alias("pooled"))
    df = pooled.select(F.hash("scan").cast("long").alias("patient_id"), (F.substring_index("scan", "-", 1).cast("int") % 2).cast("double").alias("label"), array_to_vector("pooled").alias("features"))
    k = F.pmod(F.col("patient_id"), F.lit(5))
    return M.quality_probe(df.withColumn("split", F.when(k < 3, "train").when(k == 3, "valid").otherwise("test")))[0].select("patient_id", "split", "label", "prob")


@query("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) - 12.706204736 * stddev_samp(x) / sqrt(count(*)), 3) AS low, round(avg(x) + 12.706204736 * stddev_samp(x) / sqrt(count(*)), 3) AS high FROM (SELECT a.auroc - b.auroc AS x FROM auc a JOIN auc b USING (task) WHERE a.model = 'A' AND b.model = 'B')", _MET)
def paired_delta(spark, d):
    auc = E.auroc(B.predictions(spark, d)).groupBy("task").pivot("model", ["A", "B"]).agg(F.first("auroc"))
    return rounded(rounded(E.paired_delta(auc, "A", "B"), "mean"), "low", "high", digits=3)
