"""Counts and descriptions of cohorts, slices of them, patients and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import numbered, written
from .running import quantiles


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def link_summary(df: DataFrame, linked: str, offset: str, time: str) -> DataFrame:
    """Linked and missing rows, mean and population SD of the offsets, first and last day."""
    return df.agg(F.count(linked).alias("linked"), F.count(F.when(F.col(linked).isNull(), 1)).alias("missing"), F.avg(offset).alias("mean_offset"), F.stddev_pop(offset).alias("sd_offset"), F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"))


def label_counts(df: DataFrame) -> DataFrame:
    """df (task, split, label; null: censored): positive, negative, censored, total, and percent of the split's total."""
    rows = df.groupBy("task", "split").agg(F.count(F.when(F.col("label"), 1)).alias("positive"), F.count(F.when(~F.col("label"), 1)).alias("negative"), F.count(F.when(F.col("label").isNull(), 1)).alias("censored"), F.count(F.lit(1)).alias("total"))
    return rows.withColumns({f"{c}_percent": 100 * F.col(c) / F.col("total") for c in ("positive", "negative", "censored")})


def distribution_by_split(df: DataFrame, c: str, split: str = "split") -> DataFrame:
    """Rows of each value in each split and their percent of the split."""
    counts = df.groupBy(split, c).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(split)))


def density_quartile(df: DataFrame, c: str) -> DataFrame:
    """quartile (1 to 4) by the column's exact percentiles, ties in the lower one."""
    cuts = quantiles(df.select(F.col(f"`{c}`").alias("_x")), [], "_x", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})  # one row
    x = F.col(f"`{c}`")
    return df.crossJoin(F.broadcast(cuts)).withColumn("quartile", F.when(x <= F.col("_q1"), 1).when(x <= F.col("_q2"), 2).when(x <= F.col("_q3"), 3).when(x.isNotNull(), 4)).drop("_q1", "_q2", "_q3")


def describe_slices(studies: DataFrame, by: list[str]) -> DataFrame:
    """A row for all studies and for each level of each of `by` (not crossed).

    studies: study_id, person_id, y (0/1), codes (distinct), total (counts), tte_days, event, age, sex, site, key (a key feature,
    null or 0 where missing), oldest (has an event in the widest window). They are written once, as three aggregations read them.
    """
    studies = written(studies.select(*dict.fromkeys(["person_id", "y", "codes", "total", "tte_days", "event", "age", "sex", "site", "key", "oldest", *by])))
    levels = F.explode(F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("level")), *(F.struct(F.lit(c).alias("dim"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("level")) for c in by)))
    rows = studies.withColumn("_l", levels).select("_l.dim", "_l.level", *studies.columns)
    sites = rows.groupBy("dim", "level", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("dim", "level").agg(F.count("site").alias("n_sites"), (F.max("n") / F.sum("n")).alias("top_site_share"))
    known = F.col("tte_days").isNotNull()
    main = rows.groupBy("dim", "level").agg(
        F.count(F.lit(1)).alias("n_studies"), F.count_distinct("person_id").alias("n_patients"), F.avg("y").alias("event_rate"), F.sum("y").cast("long").alias("n_positive"),
        F.avg("codes").alias("mean_codes"), F.avg("total").alias("mean_total"),
        (1 - F.avg(F.when(known, F.col("event")))).alias("censoring_rate"), F.avg("age").alias("age_mean"),
        F.avg((F.coalesce("sex", F.lit("")) == "female").cast("int")).alias("frac_female"), F.avg((F.coalesce("key", F.lit(0)) == 0).cast("int")).alias("key_missing"), F.avg(F.coalesce("oldest", F.lit(False)).cast("int")).alias("frac_oldest"),
    )
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in ("codes", "tte_days", "age"))))
    cuts = quantiles(rows.select("dim", "level", cells.alias("c")).select("dim", "level", "c.m", "c.v"), ["dim", "level", "m"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda m, c: F.max(F.when(F.col("m") == m, c))
    cuts = cuts.groupBy("dim", "level").agg(of("codes", F.col("q2")).alias("median_codes"), of("tte_days", F.col("q2")).alias("median_tte"), of("age", F.col("q3") - F.col("q1")).alias("age_iqr"))
    return main.join(sites, ["dim", "level"]).join(cuts, ["dim", "level"], "left")


def vocab_shares(long: DataFrame, slices: DataFrame) -> DataFrame:
    """Share of each vocabulary among a slice's observed cells; slices: study_id, level."""
    counts = long.where("value is not null and value <> 0").join(slices, "study_id").groupBy("level", "vocabulary").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("level", "vocabulary", (F.col("n") / F.sum("n").over(Window.partitionBy("level"))).alias("share"))


def patient_table(studies: DataFrame) -> DataFrame:
    """studies, split (or 'mixed'), positives, earliest tte and any event of each patient."""
    split = F.when(F.count_distinct("split") > 1, "mixed").otherwise(F.min("split"))
    return studies.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_studies"), split.alias("split"), F.sum("y").cast("long").alias("n_positive"), F.min("tte_days").alias("first_tte"), F.max("event").alias("any_event"))


def attach_metric(slices: DataFrame, metrics: DataFrame, name: str) -> DataFrame:
    """slices (dim, level) with the metric (dim, level, value) of those that have one."""
    return slices.join(metrics.select("dim", "level", F.col("value").alias(name)), ["dim", "level"], "left")


def profile(df: DataFrame) -> DataFrame:
    """column, type, missing and percent missing of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("missing")) for c, t in df.dtypes)))
    return counts.select("_rows", cells.alias("c")).select("c.column", "c.type", "c.missing", F.when(F.col("_rows") > 0, 100 * F.col("c.missing") / F.col("_rows")).alias("missing_percent"))


def matrix_stats(long: DataFrame, n_studies: int, n_features: int) -> DataFrame:
    v = F.col("value")
    nonzero = F.count(F.when(v.isNotNull() & ~F.isnan(v) & (v != 0), 1))
    cells = n_studies * n_features
    return long.agg(F.lit(n_studies).alias("rows"), F.lit(n_features).alias("columns"), nonzero.alias("nonzero"), (nonzero / F.lit(float(cells))).alias("density"), F.count(F.when(F.isnan(v), 1)).alias("nan"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias("inf"))


def summary(studies: DataFrame, long: DataFrame) -> DataFrame:
    """Studies, patients, event rate, share of studies with any measurement, median time to event."""
    measured = studies.join(long.where("value is not null").select("study_id").distinct().withColumn("_m", F.lit(1)), "study_id", "left")
    counts = measured.agg(F.count(F.lit(1)).alias("n_studies"), F.count_distinct("person_id").alias("n_patients"), F.avg("y").alias("event_rate"), F.avg(F.coalesce("_m", F.lit(0))).alias("measured"))
    return counts.crossJoin(quantiles(studies, [], "tte_days", {"median_tte": 0.5}))  # a row each


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def mean_by_patient(df: DataFrame, value: str = "prob") -> DataFrame:
    return df.groupBy("patient_id").agg(F.avg(value).alias(value))


def latest_run(runs: DataFrame, task: str, time: str) -> DataFrame:
    """The most recent run of each task, ties by the largest row."""
    others = [c for c in runs.columns if c not in (task, time)]
    return runs.groupBy(task).agg(F.max(F.struct(time, *others)).alias("_r")).select(task, "_r.*")


def rank_runs(runs: DataFrame, metric: str, tie: str) -> DataFrame:
    """runs with their place from 1: the highest metric first, missing ones last."""
    out = numbered(runs, [F.desc_nulls_last(metric), F.col(tie)], "place")
    return out.withColumn("place", F.col("place") + 1)


def top1_per(df: DataFrame, key: str, by: Column, tie: str) -> DataFrame:
    """The row of each key with the largest `by`, ties to the smaller `tie`."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by.desc_nulls_last(), tie))).where("_r = 1").drop("_r")
