"""Small literal cases: what the tables of the queries don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import notes, scalars
from cohortspark.operators import anchors as A
from cohortspark.operators import cohort as K
from cohortspark.operators import concepts as C
from cohortspark.operators import evaluate as E
from cohortspark.operators import features as X
from cohortspark.operators import quality as Q
from cohortspark.operators import series as S
from cohortspark.operators import splits as P
from cohortspark.operators import windows as W
from cohortspark.sources import io

DAY = dt.datetime(2020, 5, 20, 10)


def before(days, hours=0):
    return DAY - dt.timedelta(days=days, hours=hours)


@pytest.fixture(scope="module")
def anchors(spark):
    return spark.createDataFrame([(1, 10, DAY), (2, 20, DAY), (3, 30, DAY)], "study_id long, person_id long, anchor_time timestamp")


@pytest.fixture(scope="module")
def events(spark):
    rows = [(10, "V", "c", 0, before(0, 3), 1, 9.0), (10, "V", "c", 1, before(1), 2, 5.0), (10, "V", "c", 1, before(1, -5), 3, 4.0), (10, "V", "c", 1, before(7), 4, 1.0), (10, "V", "c", 1, before(8), 5, 7.0), (10, "V", "c", 1, before(3), 6, None), (10, "V", "d", 0, before(2), 7, 0.0), (30, "V", "c", 1, before(-1), 8, 3.0)]
    return spark.createDataFrame(rows, "person_id long, vocabulary string, code string, concept_id long, event_time timestamp, event_id long, value double")


@pytest.mark.parametrize("bucket", [None, 1, 3, 400])
def test_window_edges(events, anchors, bucket):
    got = sorted(r.event_id for r in W.window_join(events, anchors, 7, bucket_days=bucket).collect())
    assert got == [2, 3, 4, 6, 7]  # not the anchor's day, not day 8, not the day after


def test_window_cap(events, anchors):
    capped = anchors.withColumn("cap", F.when(F.col("study_id") == 1, 2).otherwise(0))
    assert sorted(r.event_id for r in W.window_join(events, capped, 7, "cap").collect()) == [2, 3, 7]
    assert W.window_join(events, capped.withColumn("cap", F.lit(0)), 7, "cap", bucket_days=5).count() == 0


def test_lab_features(events, anchors):
    got = {(r.code, r.agg, r.window_days): r.value for r in X.lab_features(events, anchors, (2, 7, 30)).collect()}
    assert got["c", "last", 2] == 4.0  # of two on day 1 the later
    assert (got["c", "n", 2], got["c", "n", 7], got["c", "n", 30]) == (2, 3, 4)
    assert (got["c", "min", 7], got["c", "max", 30], got["c", "days_since", 30]) == (1.0, 7.0, 1)
    assert got["d", "mean", 7] == 0.0
    for a in ("n", "max"):
        assert got["c", a, 2] <= got["c", a, 7] <= got["c", a, 30]


def test_counts_are_zero_and_labs_null_without_events(events, anchors):
    long = X.count_features(events.withColumn("vocabulary", F.lit("V")), anchors, (7,)).select("study_id", F.col("code").alias("feature"), "value")
    wide = {r.study_id: r for r in X.to_wide(long, anchors, ["c", "d"], 0.0).collect()}
    assert (wide[1].c, wide[1].d, wide[2].c, wide[3].d) == (3.0, 1.0, 0.0, 0.0)
    assert {r.c for r in X.to_wide(long, anchors, ["c"]).where("study_id <> 1").collect()} == {None}


def test_length_of_stay(spark, anchors):
    day = lambda d: (DAY - dt.timedelta(days=d)).date()
    visits = spark.createDataFrame([(10, day(5), day(2)), (10, day(3), day(-4)), (10, day(4), None), (10, day(0), day(-9)), (10, day(6), day(9))], "person_id long, start_date date, end_date date")
    row = lambda cut: X.los_features(visits, anchors, 30, cut).where("study_id = 1").first()
    assert (row(False).total_los, row(False).longest_los) == (10.0, 7.0)
    assert (row(True).total_los, row(True).longest_los) == (6.0, 3.0)
    assert X.los_features(visits, anchors, 30).where("study_id = 2").first().total_los == 0


def test_interval_open_touching_and_overlapping(spark, anchors):
    day = lambda d: (DAY - dt.timedelta(days=d)).date()
    intervals = spark.createDataFrame([(1, 10, day(9), None), (2, 10, day(3), day(0)), (3, 10, day(3), day(0)), (4, 10, day(2), day(1)), (5, 20, day(4), day(1))], "interval_id long, person_id long, start_date date, end_date date")
    assert [(r.study_id, r.interval_id) for r in W.encompassing_interval(anchors, intervals).collect()] == [(1, 3)]


def test_concept_zero_goes(events, anchors):
    assert [r.event_id for r in C.timeline({"t": events.withColumn("value", F.col("event_id").cast("double"))}, anchors, {"t": 2}).withColumn("event_id", F.col("value").cast("int")).orderBy("event_id").collect()] == [2, 3]


def test_asof(spark):
    left = spark.createDataFrame([(1, 1, DAY), (1, 2, before(50)), (2, 3, DAY)], "p int, l int, left_time timestamp")
    right = spark.createDataFrame([(1, 7, before(1)), (1, 8, before(-1)), (1, 6, before(1))], "p int, r int, right_time timestamp")
    assert {x.l: x.r for x in W.asof_nearest(left, right, "p", "l", "r", 2).collect()} == {1: 6, 2: None, 3: None}
    labels = spark.createDataFrame([(1, 1, DAY), (1, 2, before(9)), (2, 3, DAY)], "p int, label_id int, time timestamp")
    values = spark.createDataFrame([(1, DAY, "same"), (1, before(3), "old"), (1, before(-3), "late")], "p int, time timestamp, v string")
    assert {x.label_id: x.v for x in W.asof_backward(labels, values, "p", "v").collect()} == {1: "same", 2: None, 3: None}


def test_labels(spark, anchors):
    df = spark.createDataFrame([(" true ",), ("0",), ("Censored",), (None,), ("",), ("YES",), ("maybe",)], "x string")
    assert [r.label for r in A.labelled(df, "x").collect()] == [True, False, True, None]
    outcomes = spark.createDataFrame([(10, DAY), (20, before(-30))], "person_id long, event_time timestamp")
    seen = spark.createDataFrame([(10, before(-30)), (20, before(-40)), (30, before(-3))], "person_id long, last_seen timestamp")
    assert {r.study_id: r.label for r in A.horizon_labels(anchors, outcomes, seen, 30).collect()} == {1: False, 2: True, 3: None}


def test_greedy_links(spark):
    reports = spark.createDataFrame([(1, "a", before(5)), (2, "a", before(4)), (3, "a", before(3)), (4, "b", DAY)], "report_id long, patient string, report_time timestamp")
    orders = spark.createDataFrame([(7, "a", before(6)), (8, "a", before(4)), (9, "a", before(2)), (5, "b", before(11)), (6, "b", before(-1))], "order_id long, patient string, order_time timestamp")
    assert sorted(map(tuple, K.link_greedy(reports, orders).collect())) == [(1, 7, 1), (2, 8, 0)]


def test_one_class_and_extreme_scores(spark):
    df = spark.createDataFrame([("m", "t", 1, 1.0, 0.0), ("m", "t", 2, 1.0, 1.0), ("m", "u", 1, 1.0, 0.5), ("m", "u", 2, 0.0, 0.5), ("m", "v", 1, 1.0, 1.0), ("m", "v", 2, 0.0, 0.0)], "model string, task string, patient_id long, label double, prob double")
    auc = {r.task: r.auroc for r in E.auroc(df).collect()}
    assert auc == {"t": None, "u": 0.5, "v": 1.0}
    assert {r.task: r.auprc for r in E.auprc(df).collect()} == {"t": None, "u": 0.5, "v": 1.0}
    assert {r.task: r.ece for r in E.ece(df).collect()}["v"] == 0.0  # a score of 1 is in no bin
    flipped = {r.task: r.auroc for r in E.auroc(df.withColumn("prob", 1 - F.col("prob"))).collect()}
    assert flipped["v"] == 0.0 and flipped["u"] == 0.5
    assert E.auroc(df.limit(0)).count() == 0
    ci = E.bootstrap_ci(df.where("task = 'v'"), "patient_id", n=50).first()
    assert ci.low == ci.high == 1.0


def test_paired_delta():
    assert abs(E.t_quantile(0.975, 4) - 2.776445) < 1e-5
    assert E.subsets(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]


def test_fusion_learns_and_falls_back(spark):
    rows = [(i, m, float(i % 2), 0.8 if (i % 2) == (m == "a") else 0.3) for i in range(60) for m in ("a", "b")] + [(100 + i, m, float(i == 0 or (i % 2)), 0.6 + i / 100) for i in range(9) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "patient_id long, model string, label double, prob double")
    out = E.fuse(df.where("patient_id >= 100"), df.where("patient_id < 60"), ["a", "b"])
    assert out.count() == 60
    one = E.fuse(df.where("label = 1"), df.where("patient_id < 2"), ["a", "b"]).collect()
    assert all(abs(r.prob - scalar(0.5 * logit(0.8) + 0.5 * logit(0.3))) < 1e-6 or abs(r.prob - scalar(logit(0.8))) < 1 for r in one)


def logit(p):
    import math

    return math.log(p / (1 - p))


def scalar(x):
    import math

    return 1 / (1 + math.exp(-x))


def test_splits_never_part_a_group(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("g"), (F.col("id") % 500 % 3).alias("s"), "id")
    out = P.stratified_group_split(df, "g", "s", {"train": 0.7, "valid": 0.1, "test": 0.2}, 1)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    counts = {(r.s, r.split): r.n for r in out.groupBy("s", "split").agg(F.count_distinct("g").alias("n")).collect()}
    for s, n in ((0, 167), (1, 167), (2, 166)):
        assert sum(counts[s, x] for x in ("train", "valid", "test")) == n
        assert abs(counts[s, "train"] - 0.7 * n) < 1
    folds = P.patient_folds(df, "g", 5, 3)
    assert folds.where("role = 'test'").count() == 3000 and folds.count() == 15000
    kept = P.sample_keys(df, "g", 0.31, 9)
    assert kept.select("g").distinct().count() == 155 and kept.count() == 155 * 6
    again = P.sample_keys(df.repartition(7), "g", 0.31, 9)
    assert again.exceptAll(kept).count() == 0
    copies = P.balanced_sample(df.withColumn("y", F.col("g") < 50), "y", "id", 400, 2).groupBy("y").count().collect()
    assert all(300 < r["count"] < 500 for r in copies)


def test_guards(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train")], "k int, split string")
    with pytest.raises(ValueError):
        K.dedup_guarded(df, "k", [F.col("split")])
    with pytest.raises(ValueError):
        Q.require_split(df, "valid")
    with pytest.raises(ValueError):
        Q.require_split(df, "train", "part")
    assert Q.split_overlap(df, "k").collect()[0][:] == ("test", "train", 1)
    assert {r.status for r in Q.cohort_checks(df).where("check = 'column label present'").collect()} == {"FAIL"}


def test_series(spark):
    s = spark.createDataFrame([("a", 2, [1.0, 5.0]), ("a", 0, [0.0, 3.0]), ("b", 0, [0.0, 9.0])], "scan string, slice_idx int, vector array<double>")
    assert [r.vector for r in S.contextualize(s).where("scan = 'a'").orderBy("slice_idx").collect()] == [[0.0, 3.0, 0.0, 0.0, -1.0, -2.0], [1.0, 5.0, 1.0, 2.0, 0.0, 0.0]]
    assert [r.position for r in S.add_position(s).orderBy("scan", "slice_idx").collect()] == [0.0, 1.0, 0.0]
    f = {r.scan: r for r in S.fix_length(S.build_series(s), 2).collect()}
    assert f["b"].vectors == [[0.0, 9.0], [0.0, 0.0]] and f["b"].mask == [1, 0]
    assert len(S.fix_length(S.build_series(s), 1, "random").where("scan = 'a'").first().vectors) == 1
    assert {r.scan for r in S.drop_zero_series(s).collect()} == {"a"}


def test_scalars(spark):
    one = spark.range(1)
    v = one.select(
        scalars.severity_score(F.lit(81), F.lit(True), F.lit(False), F.lit(110), F.lit(100), F.lit(89.9)).alias("score"), scalars.severity_score(F.lit(81), F.lit(True), F.lit(None).cast("boolean"), F.lit(110), F.lit(100), F.lit(89.9)).alias("none"),
        scalars.decade_band(F.lit(20.5)).alias("band"), scalars.scan_key(F.lit("x.nii.gz.nii.gz")).alias("key"),
    ).first()
    assert (v.score, v.none, v.band, v.key) == (4, None, "21-40", "x.nii.gz")


def test_sections(spark):
    df = spark.createDataFrame([("a  Findings: x IMPRESSION: pe. END OF IMPRESSION", "IMPRESSION: pe. "), ("CONCLUSION; none", "CONCLUSION; none"), ("nothing", None), (None, None), ("conclusion: b Impression; c SUMMARY: d", "Impression; c ")], "t string, want string")
    for r in df.select("want", notes.section(F.col("t")).alias("got")).collect():
        assert r.got == r.want
    assert df.where("t = 'nothing'").select(notes.section(F.col("t"), strict=False)).first()[0] == "nothing"


@pytest.mark.parametrize("text,want", [
    ("seen 1/11/2000 12:30 PM by DR. JOHN DOE AND left", "seen <TIMEX3>X/XX/XXXX XX:XX AM_PM</TIMEX3> by <PERSON>DR. FIRST_NAME LAST_NAME</PERSON> AND left"),
    ("Dr. Miller may call PAGER 12-34", "<PERSON>DR. LAST_NAME</PERSON> may call <PAGER>PAGER XX-XX</PAGER>"),
    ("AT 1430 on September 16, 2019", "AT <TIMEX3>XXXX</TIMEX3> on <TIMEX3>MONTH XX, XXXX</TIMEX3>"),
    ("Smith and SMITH", "<PERSON>NAME</PERSON> and <PERSON>NAME</PERSON>"),
    ("Monday 30Jan2019", "<TIMEX3>DAY</TIMEX3> <TIMEX3>XXMONTHXXXX</TIMEX3>"),
    ("", ""),
])
def test_anonymized(text, want):
    assert notes.Tagger().replaced(text, notes.Names(["Smith"]).found(text)) == want


def test_same_for_one_and_many_partitions(spark, events, anchors):
    seen = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, X.lab_features(events, anchors).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_empty_inputs(events, anchors):
    for e, a in ((events.limit(0), anchors), (events, anchors.limit(0))):
        assert X.lab_features(e, a).count() == 0 and X.count_features(e, a).count() == 0 and X.baseline_delta(e, a, 7, (8, 30)).count() == 0


def test_tables_and_csv(spark, tmp_path):
    from cohortspark.sources import io

    name = "t_" + tmp_path.name.replace("-", "_")
    df = spark.createDataFrame([("007", 1.5), ("008", None)], "id string, x double")
    try:
        assert io.save_table(df, name) == (2, 2) and io.save_table(df.limit(1), name) == (1, 2)
        df.write.option("header", True).csv(str(tmp_path / "c"))
        assert io.create_table_from_csv(spark, str(tmp_path / "c"), name + "_c").count() == 2
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            io.create_table_from_csv(spark, str(tmp_path / "c"), name + "_c")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_c")
    assert sorted(r.id for r in io.read_delimited(spark, str(tmp_path / "c"), "id string, x double").collect()) == ["007", "008"]
    assert io.spec_key({"a": 1, "b": 2}) == io.spec_key({"b": 2, "a": 1}) != io.spec_key({"a": 1})


def test_a_refresh_leaves_what_others_read(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    made = []
    build = lambda n: lambda: made.append(n) or spark.range(n).toDF("x")
    first = io.cached(spark, folder, {"a": 1}, build(3))
    assert io.cached(spark, folder, {"a": 1}, build(9)).count() == 3 and made == [3]
    assert io.cached(spark, folder, {"a": 1}, build(5), refresh=True).count() == 5
    assert first.count() == 3 and io.cached(spark, folder, {"a": 1}, build(9)).count() == 5
    assert io.cached(spark, folder, {"a": 2}, build(2)).count() == 2
    with pytest.raises(ZeroDivisionError):
        io.cached(spark, folder, {"a": 1}, lambda: 1 / 0, refresh=True)
    assert io.cached(spark, folder, {"a": 1}, build(9)).count() == 5 and made == [3, 5, 2]
