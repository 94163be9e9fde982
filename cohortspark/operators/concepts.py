"""Vocabulary: names, hierarchy, and timelines of decoded events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import written
from .windows import window_join


def decode_concepts(df: DataFrame, concepts: DataFrame) -> DataFrame:
    """df (concept_id) with vocabulary, code and name; 'Unknown', '' and 'Unknown' where the id isn't known."""
    names = concepts.select("concept_id", F.col("vocabulary").alias("_v"), F.col("code").alias("_c"), F.col("name").alias("_n"))
    out = df.join(names, "concept_id", "left")
    return out.withColumns({"vocabulary": F.coalesce("_v", F.lit("Unknown")), "code": F.coalesce("_c", F.lit("")), "name": F.coalesce("_n", F.lit("Unknown"))}).drop("_v", "_c", "_n")


def expand_ancestors(df: DataFrame, edges: DataFrame, max_level: int) -> DataFrame:
    """A row for each ancestor (descendant, ancestor, level) of a row's concept_id, from level 1 up to max_level. The edges are
    cut to the concepts that occur before they meet the rows."""
    near = edges.where(F.col("level").between(1, max_level))
    near = near.join(df.select(F.col("concept_id").alias("descendant")).distinct(), "descendant", "left_semi")
    return df.join(near.select(F.col("descendant").alias("concept_id"), "ancestor", "level"), "concept_id")


#: Days of a word of a day bitmap.
WORD_DAYS = 63


def ancestor_features(events: DataFrame, anchors: DataFrame, edges: DataFrame, max_days: int, max_level: int, least: int, most: int) -> DataFrame:
    """Distinct event days of each ancestor in the window, for ancestors that at least `least` studies have, the `most` with the
    best coverage of these (ties by id): study_id, ancestor, n_days, days_since.

    A study's days with a concept are bits of numbers, one for each 63 days of the window that has any; the hierarchy takes the
    bits up and ors them, so no row stands for a day, and all aggregations are of numbers. That table serves coverage and counts.
    """
    rows = window_join(events.select("person_id", "concept_id", "event_time"), anchors.select("study_id", "person_id", "anchor_time"), max_days)
    bit = F.expr(f"shiftleft(1L, (days_before - 1) % {WORD_DAYS})")
    own = rows.groupBy("study_id", "concept_id", F.expr(f"(days_before - 1) div {WORD_DAYS}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    near = edges.where(F.col("level").between(1, max_level)).select(F.col("descendant").alias("concept_id"), "ancestor")
    up = own.join(near, "concept_id").groupBy("study_id", "ancestor", "word").agg(F.bit_or("bits").alias("bits"))
    first = F.expr(f"word * {WORD_DAYS} + 1 + bit_count((bits & -bits) - 1)")
    counts = up.groupBy("study_id", "ancestor").agg(F.sum(F.bit_count("bits")).alias("n_days"), F.min(first).alias("days_since"))
    counts = written(counts)  # both passes read it
    kept = counts.groupBy("ancestor").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n"), "ancestor").limit(most)
    return counts.join(kept.select("ancestor"), "ancestor", "left_semi")


def event_stack(tables: dict[str, DataFrame], anchors: DataFrame, max_days: int) -> DataFrame:
    """Events of several tables (person_id, concept_id, event_time, value) in one schema, within the window; concept 0 goes."""
    return timeline(tables, anchors, dict.fromkeys(tables, max_days))


def timeline(tables: dict[str, DataFrame], anchors: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(study_id, person_id, table, concept_id, event_time, value, days_before) of every table within its window; not sorted."""
    parts = [window_join(df.where("concept_id <> 0"), anchors.select("study_id", "person_id", "anchor_time"), windows[name]).select("study_id", "person_id", F.lit(name).alias("table"), "concept_id", "event_time", "value", "days_before") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def event_timeline(tables: dict[str, DataFrame], anchors: DataFrame, windows: dict[str, int], concepts: DataFrame) -> DataFrame:
    """The timeline with decoded concepts."""
    return decode_concepts(timeline(tables, anchors, windows), concepts)


def timeline_preview(timeline: DataFrame, n: int) -> DataFrame:
    """The first n rows by study, time, table and concept: for a look, not for export."""
    return timeline.orderBy("study_id", "event_time", "table", "concept_id", "value").limit(n)
