"""Anchor-relative features, one long table: (study_id, group, vocabulary, code, agg, window_days, value, most_recent_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ASIAN, BLACK, DEFAULT_WINDOWS, FEMALE, HISPANIC, LAB_AGGREGATES, MALE, NOT_HISPANIC, WHITE
from .windows import window_join

#: Anchor days of a person that meet counts together.
TURNS = 16

LONG = ["study_id", "group", "vocabulary", "code", "agg", "window_days", "value", "most_recent_date"]


def placed(events: DataFrame) -> DataFrame:
    """Events with a value and their place among those of the same person and code: the latest first, then the smallest event id
    and value. It tells the latest before any anchor, and unlike a struct of the three it is a number, which aggregations hash."""
    order = Window.partitionBy("person_id", "vocabulary", "code").orderBy(F.desc(F.col("event_time").cast("timestamp")), "event_id", "value")
    return events.where("value is not null").withColumn("_place", F.row_number().over(order))


def lab_features(events: DataFrame, anchors: DataFrame, windows: tuple[int, ...] = DEFAULT_WINDOWS, cap_col: str | None = None, bucket_days: int | None = None) -> DataFrame:
    """last, min, max, mean, n and days_since of each code in the windows of 1..w days before each anchor (cumulative).

    events: person_id, vocabulary, code, event_time, event_id, value (nulls don't count). One join and one aggregation for
    all windows; only aggregates are turned into rows. `last` is the value of the latest day, then of the latest time, the
    smallest event id and value. most_recent_date is the day of `last`.

    Few events of a study share a code, so rows go to their study and code as they are, not as partial aggregates of all windows,
    and are sorted and aggregated there.
    """
    order = F.struct(-F.unix_micros(F.col("event_time").cast("timestamp")), "event_id", "value")
    rows = window_join(events.where("value is not null").select("person_id", "vocabulary", "code", "event_time", "event_id", "value"), anchors, max(windows), cap_col, bucket_days)
    rows = rows.select("study_id", "vocabulary", "code", "event_time", "event_id", "value", "days_before").repartition("study_id", "vocabulary", "code")
    aggs: list[Column] = [F.min_by("value", order).alias("last"), F.min("days_before").cast("double").alias("days_since")]
    for w in windows:
        v = F.when(F.col("days_before") <= w, F.col("value"))
        aggs += [F.min(v).alias(f"min_{w}"), F.max(v).alias(f"max_{w}"), F.avg(v).alias(f"mean_{w}"), F.count(v).cast("double").alias(f"n_{w}")]
    wide = rows.groupBy("study_id", "vocabulary", "code").agg(F.max(F.to_date("event_time")).alias("most_recent_date"), *aggs)
    # all windows begin at day 1, so the latest event of one is the latest of all of them that aren't empty
    wide = wide.withColumns({f"{c}_{w}": F.when(F.col(f"n_{w}") > 0, F.col(c)) for c in ("last", "days_since") for w in windows})
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("agg"), F.lit(w).alias("window_days"), F.col(f"{a}_{w}").alias("value"), (F.col(f"n_{w}") > 0).alias("seen")) for w in windows for a in LAB_AGGREGATES)))
    long = wide.withColumn("c", cells).where("c.seen")
    return long.select("study_id", F.lit("labs").alias("group"), "vocabulary", "code", "c.agg", "c.window_days", "c.value", "most_recent_date")


def count_features(events: DataFrame, anchors: DataFrame, windows: tuple[int, ...] = DEFAULT_WINDOWS, group: str = "events", cap_col: str | None = None) -> DataFrame:
    """Distinct days with an event and the latest one, for each code and window; anchors are one row a study. Events are cut to
    their days before they meet the anchors."""
    days = events.select("person_id", "vocabulary", "code", F.to_date("event_time").alias("event_time")).distinct()
    rows = window_join(days, anchors, max(windows), cap_col)
    wide = rows.groupBy("study_id", "vocabulary", "code").agg(F.max("event_time").alias("most_recent_date"), *(F.count(F.when(F.col("days_before") <= w, 1)).alias(f"n_{w}") for w in windows))
    cells = F.explode(F.array(*(F.struct(F.lit(w).alias("window_days"), F.col(f"n_{w}").cast("double").alias("value")) for w in windows)))
    return wide.withColumn("c", cells).where("c.value > 0").select("study_id", F.lit(group).alias("group"), "vocabulary", "code", F.lit("n_days").alias("agg"), "c.window_days", "c.value", "most_recent_date")


def los_features(visits: DataFrame, anchors: DataFrame, max_days: int, cut: bool = False) -> DataFrame:
    """total and longest stay in days, at least 0, of closed visits (person_id, start_date, end_date) that began 1..max_days before
    the anchor. cut: a stay ends at the anchor at the latest, so that nothing later leaks in; without it the recorded end
    counts. Studies without visits have 0."""
    rows = window_join(visits.where("end_date is not null").withColumn("event_time", F.col("start_date")), anchors.select("study_id", "person_id", "anchor_time"), max_days)
    end = F.least(F.to_date("end_date"), F.to_date("anchor_time")) if cut else F.to_date("end_date")
    stay = F.greatest(F.lit(0), F.datediff(end, F.to_date("start_date")))
    sums = rows.groupBy("study_id").agg(F.sum(stay).alias("total_los"), F.max(stay).alias("longest_los"))
    return anchors.select("study_id").join(sums, "study_id", "left").select("study_id", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("total_los", "longest_los")))


def baseline_delta(events: DataFrame, anchors: DataFrame, recent: int, baseline: tuple[int, int]) -> DataFrame:
    """last, min, max and mean of each code in the recent window, in the baseline window of earlier days, and their
    difference (null if either is missing)."""
    rows = window_join(placed(events), anchors, max(recent, baseline[1]))
    order = F.col("_place")
    own = {"now": F.col("days_before") <= recent, "base": F.col("days_before").between(*baseline)}
    aggs = [f.alias(f"{k}_{n}") for n, w in own.items() for k, f in (("last", F.min_by("value", F.when(w, order))), ("min", F.min(F.when(w, F.col("value")))), ("max", F.max(F.when(w, F.col("value")))), ("mean", F.avg(F.when(w, F.col("value")))))]
    wide = rows.groupBy("study_id", "vocabulary", "code").agg(*aggs)
    return wide.select("study_id", "vocabulary", "code", *(c for k in ("last", "min", "max", "mean") for c in (f"{k}_now", f"{k}_base", (F.col(f"{k}_now") - F.col(f"{k}_base")).alias(f"{k}_delta"))))


def history_features(events: DataFrame, anchors: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Counts of all events before the anchor's day by code and by every ancestor of it (descendant, ancestor), plus the age.

    Anchors don't multiply events: those of a day are counted, and belong to the person's first anchor day after it. Running
    sums over the anchor days that a code has events for make the counts, which hold until the next such day. A count meets the
    studies of its days as one row for each TURNS anchor days that it reaches, so a row for each study and code is only made
    after the last shuffle and sort, and none for an event and study. Codes of a person are keys of their own.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    studies = anchors.where("person_id is not null and anchor_time is not null").select("study_id", "person_id", day("anchor_time").alias("day"))
    turns = studies.groupBy("person_id").agg(F.sort_array(F.collect_set("day")).alias("days"))  # as many as there are days, at most
    daily = events.where("event_time is not null").groupBy("person_id", "concept_id", day("event_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    turn = F.size(F.filter("days", lambda d: d <= F.col("day")))
    own = daily.join(turns, "person_id").select("person_id", "concept_id", turn.alias("turn"), F.size("days").alias("turns"), "n").where("turn < turns")
    up = own.join(edges.select(F.col("descendant").alias("concept_id"), "ancestor"), "concept_id").select("person_id", F.col("ancestor").alias("concept_id"), "turn", "n", "turns")
    both = own.unionByName(up).groupBy("person_id", "concept_id", "turn").agg(F.sum("n").alias("n"), F.max("turns").alias("turns"))
    along = Window.partitionBy("person_id", "concept_id").orderBy("turn")  # a row an anchor day, at most
    until = F.coalesce(F.lead("turn").over(along), F.col("turns")) - 1
    held = both.withColumns({"value": F.sum("n").over(along).cast("double"), "until": until})
    bucket = lambda c: F.expr(f"{c} div {TURNS}")
    held = held.select("person_id", "concept_id", "value", F.col("turn").alias("_first"), "until", F.explode(F.sequence(bucket("turn"), bucket("until"))).alias("_bucket"))
    placed_ = studies.join(turns, "person_id").select("study_id", "person_id", (F.array_position("days", F.col("day")) - 1).cast("int").alias("turn")).withColumn("_bucket", bucket("turn"))
    counts = placed_.join(held, ["person_id", "_bucket"]).where("turn between _first and until").select("study_id", "concept_id", "value")
    age = anchors.join(persons.select("person_id", "birth_time"), "person_id").select("study_id", F.lit(None).cast("long").alias("concept_id"), age_years(F.col("birth_time"), F.col("anchor_time")).alias("value"))
    return counts.withColumn("feature", F.lit("count")).unionByName(age.withColumn("feature", F.lit("age")))


def binned_features(rows: DataFrame, edges_by_group: dict[str, tuple[int, ...]]) -> DataFrame:
    """Counts in disjoint bins of days before the anchor, with bins of its own for each table group: bin i holds days above
    edge i-1 up to edge i; what lies beyond the last edge, or in no group, doesn't count."""
    bin_ = F.lit(None).cast("int")
    for group, edges in edges_by_group.items():
        first = F.lit(None).cast("int")
        for edge in sorted(edges, reverse=True):
            first = F.when(F.col("days_before") <= edge, edge).otherwise(first)
        bin_ = F.when(F.col("group") == group, first).otherwise(bin_)
    return rows.withColumn("bin", bin_).where("bin is not null").groupBy("study_id", "group", "code", "bin").agg(F.count(F.lit(1)).alias("n"))


def sequences(rows: DataFrame) -> DataFrame:
    """Each study's events as an array of (days, code, value) in that order."""
    return rows.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct(F.col("days_before").alias("days"), "code", "value"))).alias("events"))


def dense_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each named code by study, and a 0/1 mask of what was measured."""
    wide = df.where(F.col("code").isin(names)).groupBy("study_id").pivot("code", names).agg(F.avg("value"))
    return wide.select("study_id", *(F.col(f"`{n}`") for n in names), *(F.col(f"`{n}`").isNotNull().cast("int").alias(f"{n}_mask") for n in names))


def to_wide(long: DataFrame, anchors: DataFrame, features: list[str], fill: float | None = None) -> DataFrame:
    """A row for every study and a column for every named feature (long: study_id, feature, value); missing cells are null, or
    `fill` (0 for counts)."""
    cells = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    wide = anchors.select("study_id").distinct().join(long.where(F.col("feature").isin(features)).groupBy("study_id").agg(*cells), "study_id", "left")
    return wide if fill is None else wide.fillna(fill, features)


def feature_name(group: str | Column = "group") -> Column:
    """group:VOCAB/code_agg_Nd, without the aggregate where it is a count of days."""
    agg = F.when(F.col("agg") == "n_days", F.lit("")).otherwise(F.concat(F.lit("_"), F.col("agg")))
    return F.concat(F.col(group) if isinstance(group, str) else group, F.lit(":"), F.col("vocabulary"), F.lit("/"), F.col("code"), agg, F.lit("_"), F.col("window_days").cast("string"), F.lit("d"))


_NAME = r"^([^:]+):([^/]+)/(.*?)(?:_(last|min|max|mean|n|days_since))?_(\d+)d$"


def parse_feature_name(df: DataFrame, name: str = "feature") -> DataFrame:
    """The parts of a feature's name as typed columns; nulls where it isn't one."""
    part = lambda i: F.when(F.col(name).rlike(_NAME), F.regexp_extract(name, _NAME, i))
    agg = F.when(part(4) == "", F.lit("n_days")).otherwise(part(4))
    return df.withColumns({"group": part(1), "vocabulary": part(2), "code": part(3), "agg": agg, "window_days": part(5).cast("int")})


def readable_name(df: DataFrame, concepts: DataFrame, name: str = "feature") -> DataFrame:
    """`readable`: the name with the concept's (vocabulary, code, name; one each), cut at 60 characters, before its code; names
    without a concept stay."""
    parts = parse_feature_name(df.select(name).distinct(), name).join(concepts.select("vocabulary", "code", F.col("name").alias("_concept")), ["vocabulary", "code"], "left")
    short = F.when(F.length("_concept") <= 60, F.col("_concept")).otherwise(F.concat(F.substring("_concept", 1, 57), F.lit("…")))
    tail = F.when(F.col("agg") == "n_days", F.lit("")).otherwise(F.concat(F.lit("_"), F.col("agg")))
    readable = F.concat(F.col("group"), F.lit(":"), short, F.lit(" ["), F.col("vocabulary"), F.lit("/"), F.col("code"), F.lit("]"), tail, F.lit("_"), F.col("window_days").cast("string"), F.lit("d"))
    return df.join(parts.select(name, F.coalesce(readable, F.col(name)).alias("readable")), name)


def min_coverage(long: DataFrame, least: int, key: list[str] | None = None) -> DataFrame:
    """Features seen in at least so many studies."""
    key = key or ["group", "vocabulary", "code"]
    kept = long.groupBy(*key).agg(F.count_distinct("study_id").alias("_n")).where(F.col("_n") >= least).select(*key)
    return long.join(kept, key, "left_semi")


def drop_all_missing(long: DataFrame, key: str = "feature") -> DataFrame:
    """Features with a value in some study."""
    return long.join(long.where("value is not null").select(key).distinct(), key, "left_semi")


def observed_only(long: DataFrame) -> DataFrame:
    return long.where("value is not null and value <> 0")


def age_years(birth: Column, at: Column, year: float = 365.25) -> Column:
    """Whole elapsed days over the length of a year."""
    return F.floor((F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(birth.cast("timestamp"))) / 86400) / year


def demographics(anchors: DataFrame, persons: DataFrame) -> DataFrame:
    """Nine columns for each study: age_years, is_female, sex_unknown, is_hispanic, race_white/black/asian/other/unknown.

    persons: person_id, birth_time, year_of_birth (a year alone counts from 1 July), gender, ethnicity and race concept ids.
    Null is "not known"; a person who isn't there has unknown sex and race.
    """
    birth = F.coalesce(F.col("birth_time").cast("timestamp"), F.make_date("year_of_birth", F.lit(7), F.lit(1)).cast("timestamp"))
    df = anchors.join(persons.withColumn("_there", F.lit(True)), "person_id", "left")
    race = F.coalesce("race_concept_id", F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.select(
        "study_id",
        age_years(birth, F.col("anchor_time")).alias("age_years"),
        F.when(F.col("gender_concept_id") == FEMALE, 1).when(F.col("gender_concept_id") == MALE, 0).alias("is_female"),
        (~F.coalesce(F.col("gender_concept_id").isin(FEMALE, MALE), F.lit(False))).cast("int").alias("sex_unknown"),
        F.when(F.col("ethnicity_concept_id") == HISPANIC, 1).when(F.col("ethnicity_concept_id") == NOT_HISPANIC, 0).alias("is_hispanic"),
        flag(race == WHITE).alias("race_white"),
        flag(race == BLACK).alias("race_black"),
        flag(race == ASIAN).alias("race_asian"),
        flag(~race.isin(0, WHITE, BLACK, ASIAN)).alias("race_other"),
        flag(race == 0).alias("race_unknown"),
    )


def append_demographics(long: DataFrame, demo: DataFrame, impute: bool = False) -> DataFrame:
    """long (study_id, feature, value) and the demographic columns as rows; impute: the median age and 0 elsewhere."""
    columns = [c for c in demo.columns if c != "study_id"]
    rows = demo.select("study_id", *(F.col(c).cast("double").alias(c) for c in columns))
    if impute:
        middle = rows.agg(F.expr("percentile(age_years, 0.5)").alias("_middle"))
        rows = rows.crossJoin(F.broadcast(middle)).withColumn("age_years", F.coalesce("age_years", "_middle")).drop("_middle").fillna(0.0)  # one row
    rows = rows.unpivot("study_id", columns, "feature", "value").withColumn("feature", F.concat(F.lit("demo:"), "feature"))
    return long.select("study_id", "feature", "value").unionByName(rows)


def to_long(wide: DataFrame, id_col: str = "study_id") -> DataFrame:
    """A row for every cell of a wide matrix."""
    columns = [c for c in wide.columns if c != id_col]
    return wide.select(id_col, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot(id_col, columns, "feature", "value")


def record_dates(long: DataFrame, anchors: DataFrame) -> DataFrame:
    """long with record_date: for labs the anchor less days_since of the same code and window, for counts the latest day. Rows of a
    code and window are still together from their aggregation, so the window moves none and long is made once."""
    since = F.max(F.when((F.col("group") == "labs") & (F.col("agg") == "days_since"), F.col("value").cast("int")))
    out = long.withColumn("_since", since.over(Window.partitionBy("study_id", "vocabulary", "code", "window_days")))
    out = out.join(anchors.select("study_id", "anchor_time"), "study_id")
    date = F.when(F.col("group") == "labs", F.date_sub(F.to_date("anchor_time"), F.col("_since"))).otherwise(F.col("most_recent_date"))
    return out.withColumn("record_date", date).drop("_since", "anchor_time")


def top_k(long: DataFrame, k: int, key: str = "code") -> DataFrame:
    """The k features seen in the most studies, ties by name."""
    return long.groupBy(key).agg(F.count_distinct("study_id").alias("n_studies")).orderBy(F.desc("n_studies"), key).limit(k)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
