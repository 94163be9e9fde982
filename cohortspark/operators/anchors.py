"""Anchor rows: labels, times, splits, and outcomes relative to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FALSE_TOKENS, MINUTES_PER_DAY, SKIPPED_TOKENS, TRUE_TOKENS
from .running import neighbours


def parse_label(c: str) -> Column:
    """True, false, or null for censored and missing tokens and anything unknown."""
    token = F.upper(F.trim(F.col(c).cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def is_skipped(c: str) -> Column:
    return F.col(c).isNull() | F.upper(F.trim(F.col(c).cast("string"))).isin(*SKIPPED_TOKENS)


def labelled(df: DataFrame, c: str, name: str = "label") -> DataFrame:
    """df with the parsed label; rows with censored or missing tokens go."""
    return df.where(~is_skipped(c)).withColumn(name, parse_label(c))


def resolve_time(df: DataFrame, columns: list[str], name: str = "anchor_time") -> DataFrame:
    """The first of the columns that has a time; rows without any go."""
    return df.withColumn(name, F.coalesce(*columns)).where(F.col(name).isNotNull())


def add_anchor(df: DataFrame, kind: str = "prognostic", time: str = "study_time", shift_days: int | None = None) -> DataFrame:
    """anchor_time: the study's time, a day earlier for diagnostic tasks; shift_days overrides the kind."""
    days = shift_days if shift_days is not None else {"diagnostic": 1, "prognostic": 0}[kind]
    return df.withColumn("anchor_time", F.col(time) - F.expr(f"interval {days} day"))


def one_per_patient(df: DataFrame, which: str = "first", patient: str = "person_id", time: str = "anchor_time", tie: str = "study_id") -> DataFrame:
    """The first or last study of each patient."""
    order = [F.asc(time), F.asc(tie)] if which == "first" else [F.desc(time), F.desc(tie)]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(patient).orderBy(*order))).where("_r = 1").drop("_r")


def merge_labels(mapping: DataFrame, labels: DataFrame, splits: DataFrame, key: str = "study_id") -> DataFrame:
    """Inner merge on the study; labels and splits are cut to one row a key first (the least), so that none fans out."""
    one = lambda df: df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_one")).select(key, "_one.*")
    return mapping.join(one(labels), key).join(one(splits), key)


def survival(df: DataFrame, minutes: str, censored: str) -> DataFrame:
    """tte_days and event (1 event, 0 censored, null unknown)."""
    event = F.when(parse_label(censored).isNotNull(), (~parse_label(censored)).cast("int"))
    return df.withColumns({"tte_days": F.col(minutes) / MINUTES_PER_DAY, "event": event})


def horizon_labels(anchors: DataFrame, outcomes: DataFrame, last_seen: DataFrame, horizon_days: int, offset_days: int = 0) -> DataFrame:
    """label for (study_id, person_id, anchor_time): true if an outcome (person_id, event_time) lies in (t, t + horizon], null
    (censored) if the person's last_seen is before t + horizon, else false; t is the anchor less offset_days.

    Only the next outcome after t counts: both are stacked and it is carried back in time, no join however many pairs a person
    has, and a person with very many rows is as many tasks as they have weeks.
    """
    t = anchors.select(F.struct("study_id").alias("_l"), "person_id", (F.col("anchor_time") - F.expr(f"interval {offset_days} day")).cast("timestamp").alias("t"))
    until = F.col("t") + F.expr(f"interval {horizon_days} day")
    events = outcomes.where("person_id is not null").select("person_id", F.col("event_time").cast("timestamp").alias("_next")).distinct().withColumn("_us", F.unix_micros("_next"))
    # an outcome at t itself isn't after it
    both = t.withColumn("_us", F.unix_micros("t") + 1).unionByName(events, allowMissingColumns=True)
    both = neighbours(both, "person_id", "_us", "_next").where("_l is not null")
    seen = last_seen.groupBy("person_id").agg(F.max("last_seen").alias("last_seen"))
    out = both.withColumn("_next", F.when(F.col("person_id").isNotNull(), F.col("_after"))).join(seen, "person_id", "left")
    label = F.when(F.col("_next") <= until, True).when(F.col("last_seen").isNull() | (F.col("last_seen") < until), None).otherwise(False)
    return out.select("_l.study_id", "person_id", F.col("t").alias("prediction_time"), label.alias("label"))


def coded_outcomes(events: DataFrame, codes: DataFrame, table: str | None = None) -> DataFrame:
    """Events (person_id, code, event_time, table) of the codes (code), of one source table if named."""
    events = events if table is None else events.where(F.col("table") == table)
    return events.join(codes.select("code").distinct(), "code", "left_semi")


def readmission_labels(anchors: DataFrame, visits: DataFrame, last_seen: DataFrame, horizon_days: int) -> DataFrame:
    """horizon_labels of the next inpatient start (person_id, start_date) after the study."""
    return horizon_labels(anchors, visits.select("person_id", F.col("start_date").alias("event_time")), last_seen, horizon_days)


def labels_from_columns(df: DataFrame, c: str, present: DataFrame, kind: str = "prognostic") -> DataFrame:
    """(study_id, person_id, prediction_time, label) from a label column, for persons in `present` (person_id)."""
    out = add_anchor(labelled(df, c), kind).join(present.select("person_id").distinct(), "person_id", "left_semi")
    return out.select("study_id", "person_id", F.col("anchor_time").alias("prediction_time"), "label")


def coalesced_labels(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The first source that has a label."""
    return df.withColumn(name, F.coalesce(*(parse_label(c) for c in columns)))
