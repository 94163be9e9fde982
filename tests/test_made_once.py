"""Sinks and features make the table that they are given once."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import features as X
from cohortspark.sources import io


@pytest.fixture
def counted(spark):
    """(feature rows, how many have been made)"""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return None if i % 5 == 4 else float(i)

    return spark.range(40, numPartitions=2).select(F.floor(F.col("id") / 5).alias("study_id"), F.concat(F.lit("f"), F.col("id") % 5).alias("feature"), value("id").alias("value")), made


def test_export_matrix(spark, counted, tmp_path):
    long, made = counted
    studies = spark.range(8).withColumnRenamed("id", "study_id")
    for drop, names in ((True, 4), (False, 5)):
        before = made.value
        io.export_matrix(long, studies, {}, f"file://{tmp_path}/{drop}", drop)
        assert made.value - before == 40
        x, mask = (spark.read.parquet(f"file://{tmp_path}/{drop}/{n}") for n in ("X", "mask"))
        assert x.count() == mask.count() == 8 * names
        assert mask.join(x, ["study_id", "feature"]).where("(value is not null) != (observed = 1)").count() == 0
        n = {r.feature: r.n_observed for r in spark.read.parquet(f"file://{tmp_path}/{drop}/features").collect()}
        assert n == {f"f{i}": 8 if i < 4 else 0 for i in range(names)}


def test_write_events(spark, counted, tmp_path):
    events, made = counted
    io.write_events(events, f"file://{tmp_path}/e")
    assert made.value == 40
    assert spark.read.parquet(f"file://{tmp_path}/e/parquet").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/e/csv").count() == 40


def test_fuse_sparse(spark, counted):
    long, made = counted
    rows, layout = io.fuse_sparse(long, spark.range(8).select(F.col("id").alias("study_id"), F.lit(1).alias("label")))
    assert sum(len(r.indices) for r in rows.collect()) == 32 + 31  # one value is 0
    assert layout.count() == 5 and made.value == 40


def test_record_dates(spark, counted):
    long, made = counted
    rows = long.select("study_id", F.lit("labs").alias("group"), F.lit("v").alias("vocabulary"), F.lit("c").alias("code"), F.lit(30).alias("window_days"), F.when(F.col("feature") == "f0", "days_since").otherwise("n").alias("agg"), "value", F.lit(None).cast("date").alias("most_recent_date"))
    anchors = spark.range(8).select(F.col("id").alias("study_id"), F.lit("2020-03-01").cast("timestamp").alias("anchor_time"))
    got = {(r.study_id, str(r.record_date)) for r in X.record_dates(rows, anchors).collect()}
    assert got == {(0, "2020-03-01"), (1, "2020-02-25"), (2, "2020-02-20"), (3, "2020-02-15"), (4, "2020-02-10"), (5, "2020-02-05"), (6, "2020-01-31"), (7, "2020-01-26")}
    assert made.value == 40
