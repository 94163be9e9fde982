"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AGE_BANDS, MINUTES_PER_DAY


def padded_id(c: str, width: int = 8) -> Column:
    """Zeros before a shorter id; longer ones stay whole."""
    return F.when(F.length(c) >= width, F.col(c)).otherwise(F.lpad(c, width, "0"))


def reformat_time(c: str, out: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """'dd-MON-yy hh.mm.ss.f AM' as another format; null where it isn't one."""
    month = F.initcap(F.substring(F.col(c), 4, 3))
    text = F.concat(F.substring(F.col(c), 1, 3), month, F.substring(F.col(c), 7, 12), F.lit(" "), F.upper(F.substring(F.col(c), -2, 2)))
    return F.date_format(F.try_to_timestamp(text, F.lit("dd-MMM-yy hh.mm.ss a")), out)


def age_band(age: Column) -> Column:
    out = F.lit("unknown")
    for low, high in AGE_BANDS:
        out = F.when((age >= low) & (age < high), f"{low}-{high}" if high < 200 else f"{low}+").otherwise(out)
    return out


def decade_band(age: Column) -> Column:
    """0-20, 21-40, 41-60, 61-80 and 81+, without gaps."""
    return F.when(age <= 20, "0-20").when(age <= 40, "21-40").when(age <= 60, "41-60").when(age <= 80, "61-80").when(age.isNotNull(), "81+").otherwise("unknown")


#: Raw races that count as unknown and as other.
RACE_UNKNOWN = ["Unknown", "Delines to State", "", "Declines to State"]
RACE_OTHER = ["Other", "Native Hawaiian or Other Pacific Islander"]


def source_demographics(df: DataFrame) -> DataFrame:
    """gender, race and ethnicity of source values (gender_concept_id, race_source_value, ethnicity_source_value)."""
    race = F.trim(F.substring_index("race_source_value", "|", 1))
    ethnicity = F.trim(F.substring_index("ethnicity_source_value", "|", 1))
    return df.withColumns({
        "gender": F.when(F.col("gender_concept_id") == 8532, "Female").when(F.col("gender_concept_id") == 8507, "Male").otherwise("Unknown"),
        "race": F.when(race.isNull() | race.isin(RACE_UNKNOWN), "Unknown").when(race.isin(RACE_OTHER), "Other").otherwise(race),
        "ethnicity": F.when(ethnicity.contains("Non-Hispanic"), "Non-Hispanic").when(ethnicity.contains("Hispanic/Latino"), "Hispanic").otherwise("Unknown"),
    })


def scan_key(c: str | Column) -> Column:
    """The file's name without .nii.gz at its end."""
    return F.regexp_replace(c, r"\.nii\.gz$", "")


def scan_parts(c: str) -> Column:
    """(person, time) of a scan key like 'PE123_2010-01-02'."""
    key = scan_key(c)
    return F.struct(F.substring_index(key, "_", 1).alias("person"), F.substring_index(key, "_", -1).alias("time"))


def minutes_to_days(c: str) -> Column:
    return F.col(c) / MINUTES_PER_DAY


def fractional_days(anchor: str, event: str) -> Column:
    """Days from the event to the anchor with four decimals."""
    micros = F.unix_micros(F.col(anchor).cast("timestamp")) - F.unix_micros(F.col(event).cast("timestamp"))
    return F.round(micros / 86_400_000_000, 4)


def severity_score(age: Column, cancer: Column, lung: Column, heart_rate: Column, systolic: Column, saturation: Column) -> Column:
    """0 to 6; null if an input is missing."""
    one = lambda c: F.when(c, 1).when(c.isNotNull(), 0)
    return one(age > 80) + one(cancer) + one(lung) + one(heart_rate >= 110) + one(systolic < 100) + one(saturation < 90)


def severity_inputs(anchors: DataFrame, events: DataFrame, cancer: list, lung: list, vitals: dict[str, list]) -> DataFrame:
    """The score's inputs for each study: whether a code of either set ever occurred up to two days after the anchor, the last
    value of each vital in (t - 10 days, t + 2 days] (ties: the larger), and the age from the first event (year: 365 days).

    events: person_id, code, event_time, value. What ever occurred is told by a person's first events, a row a person; only vitals
    meet the anchors one by one, those of the window.
    """
    from ..operators.windows import window_join  # which needs this module

    until, since = F.col("anchor_time") + F.expr("interval 2 day"), F.col("anchor_time") - F.expr("interval 10 day")
    sets, time = {"cancer": F.col("code").isin(cancer), "lung": F.col("code").isin(lung)}, F.col("event_time")
    firsts = [f for name, c in sets.items() for f in (F.min(F.when(c, time)).alias(f"_{name}"), F.max(c & time.isNull()).alias(f"_{name}_undated"))]
    persons = events.groupBy("person_id").agg(F.min("event_time").alias("_first"), *firsts)
    ever = lambda name: F.coalesce(F.col(f"_{name}") <= until, F.lit(False)) | F.coalesce(f"_{name}_undated", F.lit(False))
    days = F.floor((F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(F.when(F.col("_first") <= until, F.col("_first")).cast("timestamp"))) / 86400)
    out = anchors.select("study_id", "person_id", "anchor_time").join(persons, "person_id", "left").select("study_id", ever("cancer").alias("cancer"), ever("lung").alias("lung"), (days / 365).alias("age"))
    if not vitals:
        return out
    wanted = events.select("person_id", "code", "event_time", "value").where(F.col("code").isin([c for codes in vitals.values() for c in codes]) & F.col("value").isNotNull())
    around = anchors.select("study_id", "person_id", F.col("anchor_time").alias("_anchor"), (F.col("anchor_time") + F.expr("interval 3 day")).alias("anchor_time"))
    near = window_join(wanted, around, 14).drop("anchor_time").withColumnRenamed("_anchor", "anchor_time").where((time <= until) & (time > since))
    last = [F.max(F.when(F.col("code").isin(codes), F.struct("event_time", "value"))).getField("value").alias(name) for name, codes in vitals.items()]
    return out.join(near.groupBy("study_id").agg(*last), "study_id", "left")


def missing_inputs(inputs: DataFrame) -> DataFrame:
    """(input, missing): in how many studies each input of the score has no value."""
    columns = [c for c in inputs.columns if c != "study_id"]
    counts = inputs.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("input"), F.col(c).alias("missing")) for c in columns))).alias("c")).select("c.*")


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def expit(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


#: What a task's name holds, in order, and its label.
CATEGORIES = {"PE": "PE", "mortality": "Mort", "readmission": "Re-ad"}
HORIZONS = {"12_month": "12 m", "6_month": "6 m", "1_month": "1 m"}


def _first_label(c: Column, labels: dict[str, str], other: str) -> Column:
    return F.coalesce(*(F.when(c.contains(held), label) for held, label in labels.items()), F.lit(other))


def task_category(c: Column) -> Column:
    return _first_label(c, CATEGORIES, "PH")


def task_horizon(c: Column) -> Column:
    return _first_label(c, HORIZONS, "N/A")
