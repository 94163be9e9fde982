"""Plans and bounds that hold at any size of the tables."""

from pyspark.sql import functions as F

from cohortspark.operators import windows as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encompassing_interval_broadcasts_no_anchors(spark):
    anchors = spark.range(50).select(F.col("id").alias("study_id"), (F.col("id") % 5).alias("person_id"), F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("anchor_time"))
    visits = spark.range(5).select(F.col("id").alias("interval_id"), F.col("id").alias("person_id"), F.lit("2020-01-03").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    found = W.encompassing_interval(anchors, visits)
    assert "Broadcast" not in plan(found)
    assert {r.study_id for r in found.collect()} == set(range(2, 50))


def test_severity_inputs_meet_a_person_once(spark):
    """Against plain Python, with undated events; a person's events are summed up before they meet the anchors."""
    import datetime as dt
    import random

    from cohortspark.functions import scalars

    r, day = random.Random(2), lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(days=x)
    studies = [(i, r.randint(0, 6) if i % 9 else None, day(r.randint(0, 80) / 2)) for i in range(60)]
    rows = [(r.randint(0, 5), r.choice("clvwx"), day(r.randint(0, 90) / 2) if i % 8 else None, r.choice([None, 1.0, 2.0, 3.0])) for i in range(40)]
    anchors = spark.createDataFrame(studies, "study_id int, person_id int, anchor_time timestamp_ntz")
    events = spark.createDataFrame(rows, "person_id int, code string, event_time timestamp_ntz, value double")
    df = scalars.severity_inputs(anchors, events, ["c"], ["l"], {"v": ["v", "x"], "w": ["w"]})
    assert "keys=[person_id" in plan(df)
    for got in df.collect():
        _, person, at = studies[got.study_id]
        until, since = at + dt.timedelta(days=2), at - dt.timedelta(days=10)
        own = [x for x in rows if x[0] == person and (x[2] is None or x[2] <= until)]
        last = lambda codes: max(((x[2], x[3]) for x in own if x[1] in codes and x[2] and x[2] > since and x[3] is not None), default=(0, None))[1]
        first = min((x[2] for x in own if x[2]), default=None)
        assert (got.cancer, got.lung, got.v, got.w) == (any(x[1] == "c" for x in own), any(x[1] == "l" for x in own), last("vx"), last("w"))
        assert got.age == (None if first is None else (until - first).days / 365)


def test_crosswalks_hold_no_table_of_distinct_rows(spark, sf):
    """Repeated and null values, keys that are missing, null or come twice; no hash aggregation, which holds all distinct rows."""
    from cohortspark.operators import cohort as K
    from cohortspark.plans import registry

    rows = [(1, "b"), (1, "a"), (1, "b"), (1, None), (1, None), (2, None), (2, "a"), (3, "a"), (None, "a"), (4, ""), (4, "")]
    df = K.distinct_of(spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame([(1,), (1,), (2,), (4,), (5,), (None,)], "k int"), "k", "v")
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, {x for x in rows if x[0] in (1, 2, 4)}))
    assert "HashAggregate" not in plan(registry.QUERIES["crosswalk_join"](spark, sf))


def test_short_windows_come_before_concepts(spark, sf):
    """Few measurements lie in a short window, so these alone are shuffled to meet their concepts, once for all tables."""
    from cohortspark.plans import registry

    for name in ("window_join", "window_join_bucketed", "window_join_capped", "timeline", "event_timeline", "event_stack"):
        tree = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in tree.splitlines() if "Join" in x]
        assert "_bucket" not in joins[0] and any("_bucket" in x for x in joins), name
        assert name == "event_timeline" or sum("concept_id" in x for x in joins) == 1, name


def test_lab_features_aggregate_rows_once(spark):
    """Rows are ordered at their study and code only, not among all events of a person before; ties go to the later time, then
    the smaller event id, then the smaller value."""
    import datetime as dt

    from cohortspark.operators import features as X

    day = lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(days=x)
    rows = [(1, "v", "c", day(9.2), 1, 1.0), (1, "v", "c", day(9.5), 7, 2.0), (1, "v", "c", day(9.5), 3, 5.0), (1, "v", "c", day(9.5), 3, 4.0), (1, "v", "c", day(9.9), 2, None), (1, "v", "c", day(5), None, 8.0), (1, "v", "c", day(5), 0, 9.0), (1, "v", "d", day(5), 0, 9.0)]
    events = spark.createDataFrame(rows, "person_id int, vocabulary string, code string, event_time timestamp, event_id long, value double")
    anchors = spark.createDataFrame([(10, 1, day(10)), (11, 1, day(6))], "study_id int, person_id int, anchor_time timestamp")
    df = X.lab_features(events, anchors, (2, 7))
    got = {(r.study_id, r.code, r.window_days): r.value for r in df.where("agg = 'last'").collect()}
    assert got == {(10, "c", 2): 4.0, (10, "c", 7): 4.0, (10, "d", 7): 9.0, (11, "c", 2): 8.0, (11, "c", 7): 8.0, (11, "d", 2): 9.0, (11, "d", 7): 9.0}
    assert "Window" not in plan(df) and "HashAggregate" not in plan(df)
