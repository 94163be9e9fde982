"""Queries of windows, features, concepts, series and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes, scalars
from ..operators import anchors as A
from ..operators import concepts as C
from ..operators import features as X
from ..operators import series as S
from ..operators import windows as W
from . import bindings as B
from .registry import query, rounded

WINDOWS = (7, 30, 365)
_LAST = "first(value ORDER BY days_before, event_time DESC, event_id, value)"


def _lab_sql(windows=WINDOWS, within="days_before BETWEEN 1 AND {w}", src="met") -> str:
    one = "SELECT study_id, 'labs' AS \"group\", vocabulary, code, {w} AS window_days, arg AS agg, v AS value, CAST(mrd AS VARCHAR) AS most_recent_date FROM (SELECT study_id, vocabulary, code, max(event_date) AS mrd, " + _LAST + " AS l, min(value) AS mi, max(value) AS ma, avg(value) AS av, count(*) AS n, min(days_before) AS ds FROM " + src + " WHERE " + within + " GROUP BY ALL), LATERAL (VALUES ('last', l), ('min', mi), ('max', ma), ('mean', av), ('n', n), ('days_since', ds)) AS t(arg, v)"
    return " UNION ALL ".join(one.format(w=w) for w in windows)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("most_recent_date", F.col("most_recent_date").cast("string"))


@query(f"SELECT study_id, \"group\", vocabulary, code, agg, window_days, round(value, 6) AS value, most_recent_date FROM ({_lab_sql()})", B.MET)
def lab_features(spark: SparkSession, d: str) -> DataFrame:
    return _dated(rounded(X.lab_features(B.measurements(spark, d), B.anchors(spark, d), WINDOWS), "value"))


@query("SELECT study_id, event_id, concept_id, value, CAST(days_before AS BIGINT) AS days_before FROM met WHERE days_before BETWEEN 1 AND 30", B.MET)
def window_join(spark, d):
    return B.known(W.window_join(B.measured(spark, d), B.anchors(spark, d), 30), spark, d).select("study_id", "event_id", "concept_id", "value", F.col("days_before").cast("long").alias("days_before"))


@query("SELECT study_id, event_id, concept_id, value, CAST(days_before AS BIGINT) AS days_before FROM met WHERE days_before BETWEEN 1 AND 90", B.MET)
def window_join_bucketed(spark, d):
    return B.known(W.window_join(B.measured(spark, d), B.anchors(spark, d), 90, bucket_days=32), spark, d).select("study_id", "event_id", "concept_id", "value", F.col("days_before").cast("long").alias("days_before"))


@query("SELECT study_id, event_id, concept_id, value, CAST(days_before AS BIGINT) AS days_before FROM met WHERE days_before BETWEEN 1 AND least(60, study_id % 90)", B.MET)
def window_join_capped(spark, d):
    anchors = B.anchors(spark, d).withColumn("cap", F.col("study_id") % 90)
    return B.known(W.window_join(B.measured(spark, d), anchors, 60, "cap"), spark, d).select("study_id", "event_id", "concept_id", "value", F.col("days_before").cast("long").alias("days_before"))


@query("SELECT study_id, event_id, value, CAST(days_before AS BIGINT) AS days_before FROM (SELECT *, CASE code WHEN 'Brand#1' THEN 10 WHEN 'Brand#2' THEN 1 ELSE CASE vocabulary WHEN 'ECONOMY' THEN 5 ELSE 1 END END AS lo, CASE code WHEN 'Brand#1' THEN 20 WHEN 'Brand#2' THEN 3 ELSE CASE vocabulary WHEN 'ECONOMY' THEN 50 ELSE 30 END END AS hi FROM met) WHERE days_before BETWEEN 1 AND 365 AND days_before BETWEEN lo AND hi", B.MET)
def window_overrides(spark, d):
    codes = spark.sql("SELECT * FROM VALUES ('Brand#1', 10, 20), ('Brand#2', 1, 3) AS t(code, min_days, max_days)")
    domains = spark.sql("SELECT * FROM VALUES ('ECONOMY', 5, 50) AS t(domain, min_days, max_days)")
    rows = W.window_join(B.measurements(spark, d), B.anchors(spark, d), 365).withColumn("domain", F.col("vocabulary"))
    return W.window_overrides(rows, codes, domains, (1, 30)).select("study_id", "event_id", "value", F.col("days_before").cast("long").alias("days_before"))


@query("SELECT study_id, interval_id, CAST(day - start_date AS BIGINT) AS days_in FROM (SELECT a.study_id, v.interval_id, a.anchor_date + 20 AS day, v.start_date, row_number() OVER (PARTITION BY a.study_id ORDER BY v.start_date DESC, v.interval_id DESC) AS r FROM anchors a JOIN visits v ON v.person_id = a.person_id AND v.start_date <= a.anchor_date + 20 AND (v.end_date IS NULL OR v.end_date >= a.anchor_date + 20)) WHERE r = 1", f"{B.ANCHORS}, {B.VISITS}")
def encompassing_visit(spark, d):
    """The visit that each study's person is in 20 days after it."""
    anchors = B.anchors(spark, d).withColumn("anchor_time", F.col("anchor_time") + F.expr("interval 20 days"))
    found = W.encompassing_interval(anchors, B.visits(spark, d))
    return found.select("study_id", "interval_id", F.datediff(F.to_date("anchor_time"), "start_date").cast("long").alias("days_in"))


@query("SELECT study_id, \"group\", vocabulary, code, agg, window_days, round(value, 6) AS value, most_recent_date FROM (SELECT study_id, 'events' AS \"group\", vocabulary, code, 'n_days' AS agg, w AS window_days, count(DISTINCT days_before) AS value, CAST(max(event_date) AS VARCHAR) AS most_recent_date FROM met, (VALUES (7), (30), (365)) AS t(w) WHERE days_before BETWEEN 1 AND w GROUP BY ALL)", B.MET)
def count_features(spark, d):
    return _dated(X.count_features(B.measurements(spark, d), B.anchors(spark, d), WINDOWS))


def _los_sql(end: str) -> str:
    return f"SELECT study_id, CAST(coalesce(sum(los), 0) AS DOUBLE) AS total_los, CAST(coalesce(max(los), 0) AS DOUBLE) AS longest_los FROM anchors LEFT JOIN (SELECT a.study_id AS s, greatest(0, {end} - v.start_date) AS los FROM anchors a JOIN visits v USING (person_id) WHERE v.end_date IS NOT NULL AND a.anchor_date - v.start_date BETWEEN 1 AND 365) ON s = study_id GROUP BY study_id"


@query(_los_sql("v.end_date"), f"{B.ANCHORS}, {B.VISITS}")
def length_of_stay(spark, d):
    return X.los_features(B.visits(spark, d), B.anchors(spark, d), 365)


@query(_los_sql("least(v.end_date, a.anchor_date)"), f"{B.ANCHORS}, {B.VISITS}")
def length_of_stay_cut(spark, d):
    return X.los_features(B.visits(spark, d), B.anchors(spark, d), 365, cut=True)


@query("SELECT study_id, ancestor, count(DISTINCT days_before) AS n_days, CAST(min(days_before) AS BIGINT) AS days_since FROM met JOIN edges ON concept_id = descendant WHERE days_before BETWEEN 1 AND 90 AND ancestor IN (SELECT ancestor FROM (SELECT ancestor, count(DISTINCT study_id) AS n FROM met JOIN edges ON concept_id = descendant WHERE days_before BETWEEN 1 AND 90 GROUP BY 1) WHERE n >= 5 ORDER BY n DESC, ancestor LIMIT 12) GROUP BY 1, 2", f"{B.MET}, {B.EDGES}")
def ancestor_features(spark, d):
    return C.ancestor_features(B.measurements(spark, d), B.anchors(spark, d), B.edges(spark, d), 90, 2, 5, 12).withColumn("days_since", F.col("days_since").cast("long"))


@query("SELECT study_id, concept_id, ancestor, level FROM met JOIN edges ON concept_id = descendant WHERE days_before BETWEEN 1 AND 7 AND level <= 1", f"{B.MET}, {B.EDGES}")
def expand_ancestors(spark, d):
    rows = W.window_join(B.measurements(spark, d), B.anchors(spark, d), 7).select("study_id", "concept_id")
    return C.expand_ancestors(rows, B.edges(spark, d), 1)


@query("SELECT coalesce(x.study_id, y.study_id) AS study_id, coalesce(x.vocabulary, y.vocabulary) AS vocabulary, coalesce(x.code, y.code) AS code, round(l, 6) AS last_now, round(bl, 6) AS last_base, round(l - bl, 6) AS last_delta, round(mi, 6) AS min_now, round(bmi, 6) AS min_base, round(mi - bmi, 6) AS min_delta, round(ma, 6) AS max_now, round(bma, 6) AS max_base, round(ma - bma, 6) AS max_delta, round(av, 6) AS mean_now, round(bav, 6) AS mean_base, round(av - bav, 6) AS mean_delta FROM (SELECT study_id, vocabulary, code, " + _LAST + " AS l, min(value) AS mi, max(value) AS ma, avg(value) AS av FROM met WHERE days_before BETWEEN 1 AND 60 GROUP BY ALL) x FULL JOIN (SELECT study_id, vocabulary, code, " + _LAST + " AS bl, min(value) AS bmi, max(value) AS bma, avg(value) AS bav FROM met WHERE days_before BETWEEN 61 AND 365 GROUP BY ALL) y ON x.study_id = y.study_id AND x.vocabulary = y.vocabulary AND x.code = y.code", B.MET)
def baseline_delta(spark, d):
    df = X.baseline_delta(B.measurements(spark, d), B.anchors(spark, d), 60, (61, 365))
    return rounded(df, *(c for c in df.columns if c.endswith(("_now", "_base", "_delta"))))


@query("SELECT study_id, concept_id, 'count' AS feature, CAST(sum(n) AS DOUBLE) AS value FROM (SELECT study_id, concept_id, count(*) AS n FROM met WHERE days_before BETWEEN 1 AND 36500 GROUP BY 1, 2 UNION ALL SELECT study_id, ancestor, count(*) FROM met JOIN edges ON concept_id = descendant WHERE days_before BETWEEN 1 AND 36500 GROUP BY 1, 2) GROUP BY 1, 2 UNION ALL SELECT study_id, CAST(NULL AS BIGINT), 'age', round(floor((epoch(anchor_time) - epoch(CAST(birth_time AS TIMESTAMP))) / 86400) / 365.25, 6) FROM anchors JOIN persons USING (person_id)", f"{B.MET}, {B.EDGES}, {B.PERSONS}")
def history_features(spark, d):
    return rounded(X.history_features(B.measurements(spark, d), B.anchors(spark, d), B.edges(spark, d), B.persons(spark, d)), "value").select("study_id", "concept_id", "feature", "value")


@query("SELECT study_id, \"group\", code, bin, count(*) AS n FROM (SELECT study_id, vocabulary AS \"group\", code, CASE WHEN vocabulary = 'ECONOMY' THEN CASE WHEN days_before <= 7 THEN 7 WHEN days_before <= 30 THEN 30 WHEN days_before <= 365 THEN 365 END WHEN vocabulary = 'SMALL' THEN CASE WHEN days_before <= 100 THEN 100 END END AS bin FROM met WHERE days_before BETWEEN 1 AND 1000) WHERE bin IS NOT NULL GROUP BY ALL", B.MET)
def binned_features(spark, d):
    rows = W.window_join(B.measurements(spark, d), B.anchors(spark, d), 1000).withColumn("group", F.col("vocabulary"))
    return X.binned_features(rows, {"ECONOMY": (7, 30, 365), "SMALL": (100,)})


@query("SELECT study_id, count(*) AS n, string_agg(days_before || ':' || code || ':' || CAST(CAST(value AS INT) AS VARCHAR), ',' ORDER BY days_before, code, value) AS events FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY study_id", B.MET)
def sequences(spark, d):
    rows = X.sequences(W.window_join(B.measurements(spark, d), B.anchors(spark, d), 30))
    return rows.select("study_id", F.size("events").cast("long").alias("n"), F.concat_ws(",", F.transform("events", lambda e: F.concat_ws(":", e.days.cast("string"), e.code, e.value.cast("int").cast("string")))).alias("events"))


@query("SELECT study_id, round(avg(CASE WHEN code = 'Brand#1' THEN value END), 6) AS b1, round(avg(CASE WHEN code = 'Brand#2' THEN value END), 6) AS b2, CAST(count(CASE WHEN code = 'Brand#1' THEN 1 END) > 0 AS INT) AS b1_mask, CAST(count(CASE WHEN code = 'Brand#2' THEN 1 END) > 0 AS INT) AS b2_mask FROM met WHERE days_before BETWEEN 1 AND 365 AND code IN ('Brand#1', 'Brand#2') GROUP BY study_id", B.MET)
def dense_matrix(spark, d):
    rows = X.dense_matrix(W.window_join(B.measurements(spark, d), B.anchors(spark, d), 365), ["Brand#1", "Brand#2"])
    return rounded(rows.toDF("study_id", "b1", "b2", "b1_mask", "b2_mask"), "b1", "b2")


@query("SELECT study_id, CAST(coalesce(count(DISTINCT CASE WHEN code = 'Brand#1' THEN days_before END), 0) AS DOUBLE) AS b1, CAST(coalesce(count(DISTINCT CASE WHEN code = 'Brand#3' THEN days_before END), 0) AS DOUBLE) AS b3 FROM anchors LEFT JOIN (SELECT study_id, code, days_before FROM met WHERE days_before BETWEEN 1 AND 365) USING (study_id) GROUP BY study_id", B.MET)
def to_wide(spark, d):
    events = B.measurements(spark, d).withColumn("vocabulary", F.lit("V"))
    long = X.count_features(events, B.anchors(spark, d), (365,)).select("study_id", F.col("code").alias("feature"), "value")
    return X.to_wide(long, B.anchors(spark, d), ["Brand#1", "Brand#3"], 0.0).toDF("study_id", "b1", "b3")


@query("SELECT person_id, study_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY anchor_time DESC, study_id DESC) AS r FROM anchors) WHERE r = 1", B.ANCHORS)
def one_per_patient(spark, d):
    return A.one_per_patient(B.anchors(spark, d), "last").select("person_id", "study_id")


@query("SELECT study_id, \"group\", vocabulary, code, agg, window_days, round(value, 6) AS value FROM (" + _lab_sql((30,)) + ") WHERE (vocabulary, code) IN (SELECT (vocabulary, code) FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY vocabulary, code HAVING count(DISTINCT study_id) >= 40)", B.MET)
def min_coverage(spark, d):
    long = X.lab_features(B.measurements(spark, d), B.anchors(spark, d), (30,)).drop("most_recent_date")
    return rounded(X.min_coverage(long, 40), "value").select("study_id", "group", "vocabulary", "code", "agg", "window_days", "value")


@query("SELECT code, count(DISTINCT study_id) AS n_studies FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY code ORDER BY 2 DESC, 1 LIMIT 10", B.MET)
def top_k_features(spark, d):
    return X.top_k(W.window_join(B.measurements(spark, d), B.anchors(spark, d), 30), 10)


@query("SELECT study_id, feature, value FROM (SELECT study_id, 'labs:' || vocabulary || '/' || code || '_n_30d' AS feature, CAST(count(*) - 1 AS DOUBLE) AS value FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY study_id, vocabulary, code) WHERE value <> 0", B.MET)
def observed_only(spark, d):
    long = X.lab_features(B.measurements(spark, d), B.anchors(spark, d), (30,)).where("agg = 'n'")
    return X.observed_only(long.select("study_id", X.feature_name().alias("feature"), (F.col("value") - 1).alias("value")))


@query("SELECT study_id, feature, value FROM (SELECT *, count(value) OVER (PARTITION BY feature) AS n FROM (SELECT study_id, code AS feature, CASE WHEN code <> 'Brand#7' THEN max(value) END AS value FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY study_id, code)) WHERE n > 0", B.MET)
def drop_all_missing(spark, d):
    rows = W.window_join(B.measurements(spark, d), B.anchors(spark, d), 30).groupBy("study_id", F.col("code").alias("feature")).agg(F.max("value").alias("value"))
    return X.drop_all_missing(rows.withColumn("value", F.when(F.col("feature") != "Brand#7", F.col("value")))).select("study_id", "feature", "value")


@query("SELECT DISTINCT 'labs:' || vocabulary || '/' || code || '_' || agg || '_30d' AS feature, 'labs' AS \"group\", vocabulary, code, agg, 30 AS window_days FROM met, (VALUES ('last'), ('min'), ('max'), ('mean'), ('n'), ('days_since')) AS a(agg) WHERE days_before BETWEEN 1 AND 30", B.MET)
def feature_names(spark, d):
    long = X.lab_features(B.measurements(spark, d), B.anchors(spark, d), (30,))
    return X.parse_feature_name(long.select(X.feature_name().alias("feature")).distinct())


@query("SELECT f AS feature, coalesce('labs:' || n || ' [' || v || '/' || c || ']_' || agg || '_30d', f) AS readable FROM (SELECT DISTINCT vocabulary AS v, code AS c, agg, 'labs:' || vocabulary || '/' || code || '_' || agg || '_30d' AS f FROM met, (VALUES ('last'), ('min'), ('max'), ('mean'), ('n'), ('days_since')) AS a(agg) WHERE days_before BETWEEN 1 AND 30) LEFT JOIN (SELECT p_type, p_brand, CASE WHEN length(min(p_name)) <= 60 THEN min(p_name) ELSE substr(min(p_name), 1, 57) || '…' END AS n FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1, 2) ON p_type = v AND p_brand = c", B.MET)
def readable_names(spark, d):
    long = X.lab_features(B.measurements(spark, d), B.anchors(spark, d), (30,)).select(X.feature_name().alias("feature")).distinct()
    concepts = B.concepts(spark, d).where("code <> 'Brand#3'").groupBy("vocabulary", "code").agg(F.min("name").alias("name"))
    return X.readable_name(long, concepts).select("feature", "readable")


_AGE = "floor((epoch(anchor_time) - epoch(CAST(birth AS TIMESTAMP))) / 86400)"
_DEMO = f"demo AS (SELECT study_id, round({_AGE} / 365.25, 6) AS age_years, CASE gender WHEN 8532 THEN 1 WHEN 8507 THEN 0 END AS is_female, CAST(coalesce(gender, 0) NOT IN (8532, 8507) AS INT) AS sex_unknown, CASE ethnicity WHEN 38003563 THEN 1 WHEN 38003564 THEN 0 END AS is_hispanic, CAST(coalesce(race, 0) = 8527 AS INT) AS race_white, CAST(coalesce(race, 0) = 8516 AS INT) AS race_black, CAST(coalesce(race, 0) = 8515 AS INT) AS race_asian, CAST(coalesce(race, 0) NOT IN (0, 8527, 8516, 8515) AS INT) AS race_other, CAST(coalesce(race, 0) = 0 AS INT) AS race_unknown FROM (SELECT *, coalesce(birth_time, make_date(year_of_birth, 7, 1)) AS birth FROM anchors LEFT JOIN (SELECT * FROM persons WHERE person_id % 7 <> 0) USING (person_id)))"


def _demo(spark, d):
    return rounded(X.demographics(B.anchors(spark, d), B.persons(spark, d).where("person_id % 7 <> 0")), "age_years")


@query("SELECT * FROM demo", f"{B.ANCHORS}, {B.PERSONS}, {_DEMO}")
def demographics(spark, d):
    return _demo(spark, d)


@query("SELECT study_id, 'demo:' || c AS feature, round(coalesce(v, CASE WHEN c = 'age_years' THEN (SELECT quantile_cont(age_years, 0.5) FROM demo) ELSE 0 END), 6) AS value FROM demo, LATERAL (VALUES ('age_years', age_years), ('is_female', is_female), ('sex_unknown', sex_unknown), ('is_hispanic', is_hispanic), ('race_white', race_white), ('race_black', race_black), ('race_asian', race_asian), ('race_other', race_other), ('race_unknown', race_unknown)) AS t(c, v)", f"{B.ANCHORS}, {B.PERSONS}, {_DEMO}")
def append_demographics(spark, d):
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS study_id, '' AS feature, CAST(NULL AS DOUBLE) AS value WHERE false")
    return rounded(X.append_demographics(none, _demo(spark, d), impute=True), "value")


@query("SELECT study_id, 'sex_unknown' AS feature, CAST(sex_unknown AS DOUBLE) AS value FROM demo UNION ALL SELECT study_id, 'is_female', CAST(is_female AS DOUBLE) FROM demo", f"{B.ANCHORS}, {B.PERSONS}, {_DEMO}")
def to_long(spark, d):
    return X.to_long(_demo(spark, d).select("study_id", "sex_unknown", "is_female"))


@query("SELECT study_id, code, vocabulary, agg, CAST(max(event_date) AS VARCHAR) AS record_date FROM met, (VALUES ('last'), ('min'), ('max'), ('mean'), ('n'), ('days_since')) AS a(agg) WHERE days_before BETWEEN 1 AND 30 GROUP BY ALL", B.MET)
def record_dates(spark, d):
    long = X.lab_features(B.measurements(spark, d), B.anchors(spark, d), (30,))
    return X.record_dates(long, B.anchors(spark, d)).select("study_id", "code", "vocabulary", "agg", F.col("record_date").cast("string").alias("record_date"))


@query("SELECT study_id, concept_id, CAST(days_before AS BIGINT) AS days_before, 'labs' AS \"table\", value FROM met WHERE days_before BETWEEN 1 AND 7 AND concept_id <> 0 UNION ALL SELECT a.study_id, p_partkey, date_diff('day', CAST(l_shipdate AS DATE), anchor_date), 'drugs', CAST(NULL AS DOUBLE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN anchors a ON person_id = o_custkey WHERE p_partkey <> 0 AND l_returnflag = 'R' AND date_diff('day', CAST(l_shipdate AS DATE), anchor_date) BETWEEN 1 AND 30", B.MET)
def timeline(spark, d):
    return B.known(C.timeline(_tables(spark, d), B.anchors(spark, d), {"labs": 7, "drugs": 30}), spark, d).select("study_id", "concept_id", F.col("days_before").cast("long").alias("days_before"), "table", "value")


def _tables(spark, d):
    """Concepts may be unknown: what a timeline leaves goes through `known`."""
    drugs = B.measured(spark, d, "l_returnflag = 'R'").select("person_id", "concept_id", "event_time", F.lit(None).cast("double").alias("value"))
    return {"labs": B.measured(spark, d).select("person_id", "concept_id", "event_time", "value"), "drugs": drugs}


_STACKED = f"{B.MET}, stacked AS (SELECT 'labs' AS \"table\", study_id, concept_id, event_time, value, days_before FROM met WHERE concept_id <> 0 UNION ALL SELECT 'drugs', a.study_id, p_partkey, l_shipdate, CAST(NULL AS DOUBLE), date_diff('day', CAST(l_shipdate AS DATE), anchor_date) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN anchors a ON person_id = o_custkey WHERE p_partkey <> 0 AND l_returnflag = 'R')"


@query("SELECT study_id, \"table\", concept_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, value, CAST(days_before AS BIGINT) AS days_before, coalesce(p.p_type, 'Unknown') AS vocabulary, coalesce(p.p_brand, '') AS code, coalesce(p.p_name, 'Unknown') AS name FROM stacked LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON p_partkey = concept_id WHERE days_before BETWEEN 1 AND CASE \"table\" WHEN 'labs' THEN 7 ELSE 14 END", _STACKED)
def event_timeline(spark, d):
    rows = C.event_timeline(_tables(spark, d), B.anchors(spark, d), {"labs": 7, "drugs": 14}, B.concepts(spark, d).where("concept_id % 5 <> 0"))
    rows = rows.join(B.concepts(spark, d).select("concept_id"), "concept_id")
    return rows.select("study_id", "table", "concept_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "value", F.col("days_before").cast("long").alias("days_before"), "vocabulary", "code", "name")


@query("SELECT study_id, \"table\", concept_id, value, CAST(days_before AS BIGINT) AS days_before FROM stacked WHERE days_before BETWEEN 1 AND 3", _STACKED)
def event_stack(spark, d):
    return B.known(C.event_stack(_tables(spark, d), B.anchors(spark, d), 3), spark, d).select("study_id", "table", "concept_id", "value", F.col("days_before").cast("long").alias("days_before"))


@query("SELECT event_id, best[3] AS near_id, CAST(abs(best[1]) AS BIGINT) AS gap_us FROM (SELECT l.event_id, min([abs(epoch_us(r.ts) - epoch_us(l.ts)), epoch_us(r.ts), r.event_id]) AS best FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 7200000000 WHERE l.event_type = 'signup' GROUP BY l.event_id)")
def asof_nearest(spark, d):
    e = B.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("left_time"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near_id"), F.col("ts").alias("right_time"))
    out = W.asof_nearest(left, right, "user_id", "event_id", "near_id", 2 / 24)
    return out.select("event_id", "near_id", F.abs(F.unix_micros("right_time") - F.unix_micros("left_time")).alias("gap_us"))


@query("SELECT l.event_id AS label_id, l.user_id, r.value AS value FROM (SELECT * FROM events WHERE event_type = 'signup') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(spark, d):
    e = B.events(spark, d).withColumnRenamed("ts", "time")
    labels = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("label_id"), "time")
    return W.asof_backward(labels, e.where("event_type = 'click'").select("user_id", "time", "value"), "user_id", "value").select("label_id", "user_id", "value")


def _horizon_sql(t: str, until: str, source: str) -> str:
    return f"SELECT study_id, CASE WHEN EXISTS (SELECT 1 FROM {source} o WHERE o.person_id = a.person_id AND o.event_time > {t} AND o.event_time <= {until}) THEN TRUE WHEN seen IS NULL OR seen < {until} THEN NULL ELSE FALSE END AS label FROM anchors a LEFT JOIN (SELECT person_id, max(event_time) AS seen FROM measurement GROUP BY 1) USING (person_id)"


_OUT = f"{B.ANCHORS}, {B.MEASUREMENT}, outcome AS (SELECT person_id, event_time FROM measurement WHERE code IN ('Brand#1', 'Brand#2'))"


@query(_horizon_sql("a.anchor_time", "a.anchor_time + INTERVAL 180 DAY", "outcome"), _OUT)
def horizon_labels(spark, d):
    m = B.measurements(spark, d)
    codes = spark.sql("SELECT * FROM VALUES ('Brand#1'), ('Brand#2') AS t(code)")
    return A.horizon_labels(B.anchors(spark, d), A.coded_outcomes(m, codes), m.select("person_id", F.col("event_time").alias("last_seen")), 180).select("study_id", "label")


@query(_horizon_sql("(a.anchor_time - INTERVAL 1 DAY)", "a.anchor_time + INTERVAL 29 DAY", "outcome"), _OUT.replace("IN ('Brand#1', 'Brand#2')", "IN ('Brand#1', 'Brand#2') AND vocabulary = 'SMALL'"))
def source_code_labels(spark, d):
    m = B.measurements(spark, d).withColumn("table", F.col("vocabulary"))
    codes = spark.sql("SELECT * FROM VALUES ('Brand#1'), ('Brand#2') AS t(code)")
    return A.horizon_labels(B.anchors(spark, d), A.coded_outcomes(m, codes, "SMALL"), m.select("person_id", F.col("event_time").alias("last_seen")), 30, offset_days=1).select("study_id", "label")


@query(_horizon_sql("a.anchor_time", "a.anchor_time + INTERVAL 30 DAY", "readmit"), f"{B.ANCHORS}, {B.MEASUREMENT}, readmit AS (SELECT o_custkey AS person_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS event_time FROM orders)")
def readmission_labels(spark, d):
    m = B.measurements(spark, d)
    visits = B.visits(spark, d).withColumn("start_date", F.col("start_date").cast("timestamp_ntz"))
    return A.readmission_labels(B.anchors(spark, d), visits, m.select("person_id", F.col("event_time").alias("last_seen")), 30).select("study_id", "label")


_DIMS = "dims AS (SELECT scan, slice_idx, vec_id, unnest(range(64)) AS dim, CAST(unnest(vector) AS DOUBLE) AS x FROM slices)"


@query("SELECT scan, slice_idx, dim, round(x, 6) AS own, round(x - coalesce(lag(x) OVER w, x), 6) AS before, round(x - coalesce(lead(x) OVER w, x), 6) AS after FROM dims WINDOW w AS (PARTITION BY scan, dim ORDER BY slice_idx)", f"{B.SLICES}, {_DIMS}")
def contextualize(spark, d):
    s = B.slices(spark, d).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    parts = F.arrays_zip(*(F.slice("vector", 1 + 64 * i, 64).alias(n) for i, n in enumerate(("own", "before", "after"))))
    df = S.contextualize(s).select("scan", F.col("slice_idx").cast("long").alias("slice_idx"), F.posexplode(parts).alias("dim", "p"))
    return rounded(df.select("scan", "slice_idx", F.col("dim").cast("long").alias("dim"), "p.own", "p.before", "p.after"), "own", "before", "after")


@query("SELECT scan, slice_idx, round(slice_idx / CAST(greatest(count(*) OVER (PARTITION BY scan) - 1, 1) AS DOUBLE), 6) AS position FROM slices", B.SLICES)
def relative_positions(spark, d):
    df = S.add_position(B.slices(spark, d))
    return rounded(df.select("scan", F.col("slice_idx").cast("long").alias("slice_idx"), "position"), "position")


@query("SELECT scan, slice_idx, round(1.5 * slice_idx / greatest(1.5 * (count(*) OVER (PARTITION BY scan) - 1), 1.0), 6) AS position FROM slices", B.SLICES)
def slice_positions(spark, d):
    df = S.add_position(B.slices(spark, d).withColumn("thickness", F.lit(1.5)), "thickness")
    return rounded(df.select("scan", F.col("slice_idx").cast("long").alias("slice_idx"), "position"), "position")


def _placed(df):
    """A row for each place, dimension and value of a series."""
    each = df.select("scan", F.posexplode(F.arrays_zip("vectors", "mask")).alias("place", "v"))
    each = each.select("scan", F.col("place").cast("long").alias("place"), F.col("v.mask").alias("real"), F.posexplode("v.vectors").alias("dim", "value"))
    return rounded(each.withColumn("dim", F.col("dim").cast("long")), "value")


@query("SELECT scan, place, CAST(real AS INT) AS real, dim, round(CASE real WHEN 1 THEN x ELSE 0 END, 6) AS value FROM (SELECT s.scan, p.place, CASE WHEN p.place < n THEN 1 ELSE 0 END AS real, greatest(0, (n - 45) // 2) + p.place AS i FROM (SELECT scan, count(*) AS n FROM slices GROUP BY scan) s, range(45) AS p(place)) JOIN (SELECT dim FROM range(64) AS r(dim)) ON TRUE LEFT JOIN dims USING (scan, dim) WHERE dims.slice_idx = i OR (real = 0 AND dims.slice_idx = 0)", f"{B.SLICES}, {_DIMS}")
def fix_length(spark, d):
    return _placed(S.fix_slices(B.slices(spark, d), 45))


@query("SELECT scan, least(45, count(*)) AS chosen, 45 AS length, TRUE AS in_order FROM slices GROUP BY scan", B.SLICES)
def fix_length_random(spark, d):
    """What holds for any seeded choice: so many of the scan's own slices, each once, in their order."""
    s = B.slices(spark, d)
    fixed = S.fix_slices(s.withColumn("vector", F.array(F.col("slice_idx").cast("double"))), 45, "random", 3)
    chosen = F.transform(F.slice("vectors", 1, F.aggregate("mask", F.lit(0), lambda a, x: a + x)), lambda v: v[0])
    in_order = chosen == F.array_sort(F.array_distinct(F.filter(chosen, lambda x: x.isNotNull())))
    return fixed.select("scan", F.size(chosen).cast("long").alias("chosen"), F.size("vectors").alias("length"), in_order.alias("in_order"))


def _pool_sql(f: str) -> str:
    return f"SELECT scan, dim, round({f}(x), 6) AS value FROM (SELECT scan, unnest(range(64)) AS dim, CAST(unnest(vector) AS DOUBLE) AS x FROM slices) GROUP BY scan, dim"


@query(_pool_sql("avg"), B.SLICES)
def mean_pool(spark, d):
    return rounded(S.pool(B.slices(spark, d)), "value").withColumn("dim", F.col("dim").cast("long"))


@query(_pool_sql("max"), B.SLICES)
def max_pool(spark, d):
    return rounded(S.pool(B.slices(spark, d), "max"), "value").withColumn("dim", F.col("dim").cast("long"))


@query("SELECT scan, slice_idx, vec_id FROM slices WHERE scan NOT IN ('3', '5')", B.SLICES)
def drop_zero_series(spark, d):
    zero = F.concat(F.transform(F.slice("vector", 1, 63), lambda x: x * 0), F.slice("vector", 64, 1))
    s = B.slices(spark, d).withColumn("vector", F.when(F.col("scan") == "3", zero).otherwise(F.col("vector")))
    bad = spark.sql("SELECT '5' AS scan")
    return S.drop_zero_series(s, bad).select("scan", F.col("slice_idx").cast("long").alias("slice_idx"), "vec_id")


@query("SELECT scan, slice_idx AS place, dim, round(x, 6) AS value, n_slices FROM dims JOIN (SELECT scan, count(*) AS n_slices FROM slices GROUP BY scan) USING (scan) WHERE scan <> '2'", f"{B.SLICES}, {_DIMS}")
def build_series(spark, d):
    s = B.slices(spark, d)
    df = S.build_series(s, s.where("scan <> '2'").select("scan"))
    each = df.select("scan", F.col("n_slices").cast("long").alias("n_slices"), F.posexplode("vectors").alias("place", "v"))
    each = each.select("scan", F.col("place").cast("long").alias("place"), "n_slices", F.posexplode("v").alias("dim", "value"))
    return rounded(each.withColumn("dim", F.col("dim").cast("long")), "value")


@query("SELECT count(DISTINCT scan) FILTER (WHERE scan <> '2') AS written, count(DISTINCT scan) FILTER (WHERE scan = '2') AS skipped FROM slices", B.SLICES)
def series_report(spark, d):
    s = B.slices(spark, d)
    return S.series_report(s, s.where("scan <> '2'").select("scan"))


@query("SELECT scan, vec_id FROM slices WHERE slice_idx < 5", B.SLICES)
def first_slices(spark, d):
    return S.first_slices(B.slices(spark, d), 5).select("scan", "vec_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (least(greatest(CAST(x AS DOUBLE), -0.1), 0.1) + 0.1) / 0.2)), 6) AS total FROM embeddings")
def intensity_window(spark, d):
    w = S.intensity_window("embedding", 0.0, 0.2)
    return rounded(B.read(spark, d, "embeddings").select("vec_id", F.aggregate(w, F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(unnest(range(p_size)) AS INT) AS slice_idx FROM part")
def expand_slices(spark, d):
    return S.expand_slices(B.read(spark, d, "part").select("p_partkey", F.col("p_size").alias("num_slices"))).select("p_partkey", "slice_idx")


@query("SELECT note_id, substr(note, p, strpos(note, ' SUMMARY CODE') + 1 - p) AS impression FROM (SELECT *, strpos(lower(note), 'impression:') AS p FROM notes)", B.NOTES)
def impression_section(spark, d):
    return B.notes(spark, d).select("note_id", notes.section(F.col("note")).alias("impression"))


@query("SELECT note_id, substr(note, p, strpos(note, ' SUMMARY CODE') + 1 - p) AS section FROM (SELECT *, strpos(lower(note), 'impression:') AS p FROM notes) WHERE note_id % 4 <> 0 AND note_id % 7 <> 0 AND p > 0", B.NOTES)
def notes_with_section(spark, d):
    n = F.col("note_id")
    note = F.when(n % 4 == 0, F.lit(None)).when(n % 7 == 0, F.regexp_replace("note", "(?i)impression", "opinion")).otherwise(F.col("note"))
    return notes.with_section(B.notes(spark, d).withColumn("note", note), "note").select("note_id", "section")


@query("SELECT note_id, substr(note, p, strpos(note, ' SUMMARY CODE') + 1 - p) AS section FROM (SELECT note_id, note, CASE WHEN i > 0 THEN i ELSE 1 END AS p FROM (SELECT note_id, CASE WHEN note_id % 2 = 0 THEN replace(note, 'IMPRESSION:', 'OPINION') ELSE note END AS note, strpos(lower(CASE WHEN note_id % 2 = 0 THEN replace(note, 'IMPRESSION:', 'OPINION') ELSE note END), 'impression:') AS i FROM notes))", B.NOTES)
def lenient_section(spark, d):
    note = F.when(F.col("note_id") % 2 == 0, F.replace("note", F.lit("IMPRESSION:"), F.lit("OPINION"))).otherwise(F.col("note"))
    return B.notes(spark, d).select("note_id", notes.section(note, strict=False).alias("section"))


@query("SELECT note_id, replace(note, 'FINDINGS: ', '') AS note FROM notes", B.NOTES)
def without_phrases(spark, d):
    return B.notes(spark, d).select("note_id", notes.without_phrases(F.col("note"), ["FINDINGS: "]).alias("note"))


_HEDGED = f"{B.NOTES}, texts AS (SELECT note_id, note || CASE WHEN note_id % 3 = 0 THEN ' Possible PE, cannot be excluded; suspected clot.' ELSE '' END AS t FROM notes), hedged AS (SELECT note_id, [" + ", ".join(f"{{'k': '{k}', 'n': len(regexp_extract_all(t, '(?i){p}'))}}" for k, p in notes.HEDGES.items()) + "] AS h FROM texts)"


@query("SELECT note_id, list_sum([x.n FOR x IN h]) > 0 AS is_hedged, CAST(list_sum([x.n FOR x IN h]) AS BIGINT) AS match_count, array_to_string([x.k FOR x IN h IF x.n > 0], ',') AS categories FROM hedged", _HEDGED)
def hedging(spark, d):
    text = F.concat("note", F.when(F.col("note_id") % 3 == 0, " Possible PE, cannot be excluded; suspected clot.").otherwise(""))
    h = notes.hedges(text)
    return B.notes(spark, d).select("note_id", h.is_hedged.alias("is_hedged"), h.match_count.cast("long").alias("match_count"), F.concat_ws(",", h.categories).alias("categories"))


@query()
def phi_spans(spark, d):
    text = F.concat("note", F.lit(" seen 1/"), (F.col("note_id") % 28 + 1).cast("string"), F.lit("/2010 at 10:30 AM by DR. JOHN DOE AND PAGER 12-345"))
    return B.notes(spark, d).select("note_id", text.alias("note")).withColumn("spans", notes.phi_spans("note")).select("note_id", "spans")


def _with_patient(spark, d):
    """Notes that name a customer at the end."""
    n = B.read(spark, d, "customer").count()
    notes_ = B.notes(spark, d).withColumn("c_custkey", F.col("note_id") % n + 1)
    return notes_.join(B.read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("note_id", "c_name", F.concat("note", F.lit(" seen with "), F.lower(F.coalesce("c_name", F.lit("nobody"))), F.lit(" today")).alias("note"))


@query("SELECT note_id, length(note) + 11 AS start, length(note) + 11 + length(c_name) AS \"end\" FROM (SELECT *, note_id % (SELECT count(*) FROM customer) + 1 AS k FROM notes) JOIN customer ON c_custkey = k", B.NOTES)
def name_spans(spark, d):
    """Names of a table wherever a note has one: none but the one at the end."""
    names = notes.dictionary(B.read(spark, d, "customer").select(F.col("c_name").alias("name")))
    spans = _with_patient(spark, d).select("note_id", F.explode(notes.name_spans("note", names)).alias("s"))
    return spans.select("note_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query()
def anonymized_with_names(spark, d):
    names = notes.dictionary(B.read(spark, d, "customer").select(F.col("c_name").alias("name")))
    return _with_patient(spark, d).select("note_id", notes.anonymized("note", names).alias("note"))


@query()
def anonymized_notes(spark, d):
    text = F.concat("note", F.lit(" seen 1/"), (F.col("note_id") % 28 + 1).cast("string"), F.lit("/2010 by Dr. Miller"))
    return B.notes(spark, d).select("note_id", text.alias("note")).select("note_id", notes.anonymized("note").alias("note"))


@query("SELECT study_id, CASE WHEN age >= 85 THEN '85+' WHEN age >= 75 THEN '75-85' WHEN age >= 65 THEN '65-75' WHEN age >= 55 THEN '55-65' WHEN age >= 40 THEN '40-55' WHEN age >= 0 THEN '0-40' ELSE 'unknown' END AS band, CASE WHEN age <= 20 THEN '0-20' WHEN age <= 40 THEN '21-40' WHEN age <= 60 THEN '41-60' WHEN age <= 80 THEN '61-80' WHEN age IS NOT NULL THEN '81+' ELSE 'unknown' END AS decades FROM (SELECT study_id, age_years AS age FROM demo)", f"{B.ANCHORS}, {B.PERSONS}, {_DEMO}")
def age_bands(spark, d):
    age = F.col("age_years")
    return _demo(spark, d).select("study_id", scalars.age_band(age).alias("band"), scalars.decade_band(age).alias("decades"))


@query("SELECT study_id, CAST(max(CASE WHEN code = 'Brand#1' THEN 1 ELSE 0 END) AS BOOLEAN) AS cancer, CAST(max(CASE WHEN code = 'Brand#2' THEN 1 ELSE 0 END) AS BOOLEAN) AS lung, round(floor((epoch(any_value(anchor_time) + INTERVAL 2 DAY) - epoch(min(event_time))) / 86400) / 365, 6) AS age, arg_max(value, [epoch(event_time), value]) FILTER (WHERE code IN ('Brand#3', 'Brand#4') AND event_time > anchor_time - INTERVAL 10 DAY) AS heart FROM anchors LEFT JOIN measurement USING (person_id) WHERE event_time IS NULL OR event_time <= anchor_time + INTERVAL 2 DAY GROUP BY study_id UNION ALL SELECT study_id, FALSE, FALSE, NULL, NULL FROM anchors a WHERE EXISTS (SELECT 1 FROM measurement m WHERE m.person_id = a.person_id) AND NOT EXISTS (SELECT 1 FROM measurement m WHERE m.person_id = a.person_id AND m.event_time <= a.anchor_time + INTERVAL 2 DAY)", f"{B.ANCHORS}, {B.MEASUREMENT}")
def severity_inputs(spark, d):
    df = scalars.severity_inputs(B.anchors(spark, d), B.measurements(spark, d), ["Brand#1"], ["Brand#2"], {"heart": ["Brand#3", "Brand#4"]})
    return rounded(df, "age").select("study_id", "cancer", "lung", "age", "heart")


@query("SELECT 'hr' AS input, count(*) FILTER (WHERE v IS NULL) AS missing FROM (SELECT a.study_id, max(value) FILTER (WHERE code = 'Brand#3' AND event_time <= anchor_time + INTERVAL 2 DAY AND event_time > anchor_time - INTERVAL 10 DAY) AS v FROM anchors a LEFT JOIN measurement USING (person_id) GROUP BY 1) UNION ALL SELECT 'cancer', 0 UNION ALL SELECT 'lung', 0", f"{B.ANCHORS}, {B.MEASUREMENT}")
def severity_missing(spark, d):
    inputs = scalars.severity_inputs(B.anchors(spark, d), B.measurements(spark, d), ["Brand#1"], ["Brand#2"], {"hr": ["Brand#3"]})
    return scalars.missing_inputs(inputs.drop("age"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_quantity > 40)::INT + (l_returnflag = 'R')::INT + (l_linestatus = 'F')::INT + (l_extendedprice >= 50000)::INT + (l_discount < 0.02)::INT + (l_tax < 0.01)::INT AS score FROM lineitem")
def severity_score(spark, d):
    c = F.col
    s = scalars.severity_score(c("l_quantity") + 40, c("l_returnflag") == "R", c("l_linestatus") == "F", c("l_extendedprice") / 50000 * 110, c("l_discount") / 0.02 * 100, c("l_tax") / 0.01 * 90)
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", s.alias("score"))


@query("SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '2024-06-01') / 86400000000, 4) AS days FROM events")
def fractional_days(spark, d):
    e = B.events(spark, d).withColumn("anchor", F.lit("2024-06-01").cast("timestamp"))
    return e.select("event_id", scalars.fractional_days("anchor", "ts").alias("days"))
