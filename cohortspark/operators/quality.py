"""Data-quality suites: each gives a table (check, status, detail); status is PASS, WARN or FAIL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(values: DataFrame, checks: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """One row of figures as a row for each check (name, holds, detail, what it is if it doesn't hold)."""
    cells = [F.struct(F.lit(n).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(bad).alias("status"), F.coalesce(d.cast("string"), F.lit("")).alias("detail")) for n, ok, d, bad in checks]
    return values.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _columns(df: DataFrame, required: list[str]) -> DataFrame:
    spark, missing = df.sparkSession, [c for c in required if c not in df.columns]
    rows = ", ".join(f"('column {c} present', '{'FAIL' if c in missing else 'PASS'}', '')" for c in required)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(check, status, detail)")


def cohort_checks(df: DataFrame, prevalence: tuple[float, float] = (0.05, 0.30), first: str = "1980-01-01", last: str = "2025-01-01") -> DataFrame:
    """Of a cohort (person_id, study_time, label 'True'/'False', split, impression_id): columns, nulls, label and split domains,
    prevalence, patients in one split, unique ids, duplicates across splits, plausible times, patients with several studies."""
    required = ["person_id", "study_time", "label", "split", "impression_id"]
    present = _columns(df, required)
    if any(c not in df.columns for c in required):
        return present
    token = F.lower(F.col("label").cast("string"))
    main = df.agg(
        *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required),
        F.count(F.when(token.isNotNull() & ~token.isin("true", "false"), 1)).alias("odd_labels"),
        F.avg((token == "true").cast("double")).alias("prevalence"),
        F.count(F.when(F.col("split").isNotNull() & ~F.col("split").isin("train", "valid", "test"), 1)).alias("odd_splits"),
        F.count(F.when(F.to_date("study_time") < F.lit(first).cast("date"), 1)).alias("early"), F.count(F.when(F.to_date("study_time") > F.lit(last).cast("date"), 1)).alias("late"),
    )
    by_patient = df.groupBy("person_id").agg(F.count_distinct("split").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("s") > 1, 1)).alias("crossing"), F.count(F.when(F.col("n") > 1, 1)).alias("several"))
    by_id = df.groupBy("impression_id").agg(F.count_distinct("split").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count(F.when((F.col("n") > 1) & (F.col("s") > 1), 1)).alias("across"))
    all_ = main.crossJoin(F.broadcast(by_patient)).crossJoin(F.broadcast(by_id))  # one row each
    c = F.col
    return present.unionByName(_report(all_, [
        *((f"no nulls in {x}", c(f"null_{x}") == 0, c(f"null_{x}"), "FAIL") for x in required),
        ("labels are true or false", c("odd_labels") == 0, c("odd_labels"), "FAIL"),
        ("prevalence in range", c("prevalence").between(*prevalence), F.round("prevalence", 4), "FAIL"),
        ("splits are train, valid or test", c("odd_splits") == 0, c("odd_splits"), "FAIL"),
        ("no patient in several splits", c("crossing") == 0, c("crossing"), "FAIL"),
        ("no duplicate impression ids", c("duplicates") == 0, c("duplicates"), "FAIL"),
        ("no duplicate across splits", c("across") == 0, c("across"), "FAIL"),
        ("no times before the first day", c("early") == 0, c("early"), "WARN"),
        ("no times after the last day", c("late") == 0, c("late"), "WARN"),
        ("patients with several studies", F.lit(True), c("several"), "PASS"),
    ]))


def label_checks(df: DataFrame, expected: float, tolerance: float = 0.02) -> DataFrame:
    """Of a label table (patient_id, time, label): columns, duplicate (patient, time), prevalence near the expected one."""
    present = _columns(df, ["patient_id", "time", "label"])
    twice = df.groupBy("patient_id", "time").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    values = df.agg(F.avg(F.col("label").cast("double")).alias("prevalence")).crossJoin(F.broadcast(twice))
    return present.unionByName(_report(values, [("no duplicate patient and time", F.col("duplicates") == 0, F.col("duplicates"), "FAIL"), ("prevalence as expected", F.abs(F.col("prevalence") - expected) <= tolerance, F.round("prevalence", 4), "FAIL")]))


def matrix_checks(long: DataFrame, cohort: DataFrame) -> DataFrame:
    """Of a feature table against its cohort (study_id, person_id, split): NaN and infinite values, studies on one side only,
    unknown splits, patients in several."""
    v = F.col("value")
    cells = long.agg(F.count(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias("bad"))
    rows = long.select("study_id").distinct().withColumn("_f", F.lit(1)).join(cohort.select("study_id").distinct().withColumn("_c", F.lit(1)), "study_id", "full").agg(F.count(F.when(F.col("_c").isNull(), 1)).alias("strays"), F.count(F.when(F.col("_f").isNull(), 1)).alias("empty"))
    splits = cohort.agg(F.count(F.when(~F.coalesce(F.col("split"), F.lit("")).isin("train", "valid", "test"), 1)).alias("unknown"))
    crossing = cohort.groupBy("person_id").agg(F.count_distinct("split").alias("s")).agg(F.count(F.when(F.col("s") > 1, 1)).alias("crossing"))
    all_ = cells.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(splits)).crossJoin(F.broadcast(crossing))
    return _report(all_, [("values are finite", F.col("bad") == 0, F.col("bad"), "FAIL"), ("rows belong to the cohort", F.col("strays") == 0, F.col("strays"), "FAIL"), ("studies have features", F.col("empty") == 0, F.col("empty"), "WARN"), ("splits are known", F.col("unknown") == 0, F.col("unknown"), "FAIL"), ("no patient in several splits", F.col("crossing") == 0, F.col("crossing"), "FAIL")])


def split_replay(images: DataFrame, mapping: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """The merge of images (scan), mapping (scan, study_id, person_id), labels (study_id, label) and splits (study_id, split)
    again: match rate, key types, missing splits, patients in several splits, single-class splits."""
    types = [images.schema["scan"].dataType == mapping.schema["scan"].dataType, mapping.schema["study_id"].dataType == splits.schema["study_id"].dataType]
    m = images.select("scan").distinct().join(mapping.dropDuplicates(["scan"]), "scan", "left").join(labels.dropDuplicates(["study_id"]), "study_id", "left").join(splits.dropDuplicates(["study_id"]), "study_id", "left")
    main = m.agg(F.avg(F.col("study_id").isNotNull().cast("double")).alias("matched"), F.count(F.when(F.col("split").isNull(), 1)).alias("missing"))
    people = m.groupBy("person_id").agg(F.count_distinct("split").alias("s")).agg(F.count(F.when(F.col("s") > 1, 1)).alias("crossing"))
    classes = m.where("split is not null").groupBy("split").agg(F.count_distinct("label").alias("k")).agg(F.count(F.when(F.col("k") < 2, 1)).alias("single"))
    all_ = main.crossJoin(F.broadcast(people)).crossJoin(F.broadcast(classes))
    return _report(all_, [("key types agree", F.lit(all(types)), F.lit(""), "FAIL"), ("all images matched", F.col("matched") == 1, F.round("matched", 4), "WARN"), ("no missing splits", F.col("missing") == 0, F.col("missing"), "FAIL"), ("no patient in several splits", F.col("crossing") == 0, F.col("crossing"), "FAIL"), ("both classes in every split", F.col("single") == 0, F.col("single"), "WARN")])


def split_prevalence(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("prevalence"))


def split_overlap(df: DataFrame, key: str) -> DataFrame:
    """Keys that two splits share, for each pair that shares any. Keys in one split end in the aggregation."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)  # as many as there are splits
    a = sets.select(key, F.posexplode("s").alias("i", "split_a"), "s").select(key, "split_a", F.explode(F.slice(F.col("s"), F.col("i") + 2, F.size("s"))).alias("split_b"))
    return a.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


def single_class_splits(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count_distinct("label").alias("classes")).where("classes < 2")


def require_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of a split; raises if there is no such column or no row."""
    if column not in df.columns:
        raise ValueError(f"no column {column} among {', '.join(df.columns)}")
    out = df.where(F.col(column) == split)
    if out.isEmpty():
        raise ValueError(f"no rows in split {split}")
    return out


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Keys on either side that meet more than one of the other."""
    n = lambda x, y: df.groupBy(x).agg(F.count_distinct(y).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias(f"{x}_repeated"))
    return n(a, b).crossJoin(F.broadcast(n(b, a)))


def failure_rate(df: DataFrame, failed: Column) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count(F.when(failed, 1))
    return df.agg(n.alias("attempts"), bad.alias("failures"), F.when(n > 0, bad / n).alias("rate"))
