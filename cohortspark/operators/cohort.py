"""Cohort construction: predicates, memberships, lookups and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

from .anchors import parse_label


def match_text(df: DataFrame, c: str, all_of: list[str], any_of: list[str]) -> DataFrame:
    """Distinct rows whose lower-cased text has all of the first words or one of the others."""
    low = F.lower(F.col(c))
    every, some = F.lit(bool(all_of)), F.lit(False)
    for w in all_of:
        every = every & low.contains(w.lower())
    for w in any_of:
        some = some | low.contains(w.lower())
    return df.where(every | some).distinct()


def keep_positive(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is true; censored, missing and unknown labels go with the negative ones."""
    return df.where(F.coalesce(parse_label(label), F.lit(False)))


def keep_in(df: DataFrame, keys: DataFrame, on: str, upper: bool = True) -> DataFrame:
    """Rows whose key is among `keys`, by default whatever the case."""
    norm = (lambda c: F.upper(F.trim(c))) if upper else (lambda c: c)
    k = keys.select(norm(F.col(on)).alias("_k")).distinct()
    return df.join(k, norm(df[on]) == F.col("_k"), "left_semi")


def drop_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't among `keys`; nulls there keep nothing away."""
    return df.join(keys.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def json_eq(df: DataFrame, c: str, path: str, value: str) -> DataFrame:
    return df.where(F.get_json_object(c, path) == value)


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows within every range, ends included."""
    for c, (low, high) in ranges.items():
        df = df.where(F.col(c).between(low, high))
    return df


def keep_domains(df: DataFrame, prefixes: list[str], code: str = "code") -> DataFrame:
    """Rows whose code ('VOCAB/code') has one of the vocabularies, whatever the case."""
    return df.where(F.upper(F.substring_index(code, "/", 1)).isin([p.upper() for p in prefixes]))


def concat_blocks(*blocks: DataFrame) -> DataFrame:
    """Feature blocks of the same studies as one long table: what is a column-wise concatenation of wide ones."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out


def restrict(instances: DataFrame, series: DataFrame, cohort: DataFrame, series_key: str, study_key: str) -> tuple[DataFrame, DataFrame]:
    """(instances of the selected series, the cohort's studies that still have one)."""
    kept = instances.join(series.select(series_key).distinct(), series_key, "left_semi")
    return kept, cohort.join(kept.select(study_key).distinct(), study_key, "left_semi")


def filter_cohort(df: DataFrame, **facets) -> DataFrame:
    """Rows that meet every facet: a value, a list of values, or (low, high) under a name ending in _between."""
    for name, want in facets.items():
        if name.endswith("_between"):
            df = df.where((F.col(name[:-8]) >= want[0]) & (F.col(name[:-8]) < want[1]))
        else:
            df = df.where(F.col(name).isin(list(want)) if isinstance(want, list | tuple | set) else F.col(name).eqNullSafe(F.lit(want)))
    return df


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows with the literal term in any column, whatever the case."""
    return df.where(F.contains(F.lower(F.concat_ws("\x1f", *(F.col(f"`{c}`").cast("string") for c in df.columns))), F.lit(term.lower())))


def patient_features(long: DataFrame, study_id) -> DataFrame:
    """One study's non-zero features by value, largest first."""
    return long.where((F.col("study_id") == study_id) & (F.col("value") != 0)).orderBy(F.desc("value"), "feature")


def eval_subset(predictions: DataFrame, splits: DataFrame, scored: DataFrame, diagnosed: DataFrame, split: str) -> DataFrame:
    """Predictions of a split whose patient has a score and a diagnosis."""
    rows = predictions.join(splits.where(F.col("split") == split).select("patient_id").distinct(), "patient_id", "left_semi")
    return rows.join(scored.select("patient_id").distinct(), "patient_id", "left_semi").join(diagnosed.select("patient_id").distinct(), "patient_id", "left_semi")


def require_series(studies: DataFrame, series: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(studies with a series, a row with how many were kept and removed)."""
    have = series.select(key).distinct().withColumn("_has", F.lit(True))
    report = studies.join(have, key, "left").agg(F.count("_has").alias("kept"), F.count(F.when(F.col("_has").isNull(), 1)).alias("removed"))
    return studies.join(have.select(key), key, "left_semi"), report


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default) -> DataFrame:
    """`value` from dim (on, value and `order`, the place of a row: the last of a key wins), or the default."""
    last = dim.groupBy(on).agg(F.max_by(value, "order").alias("_v"))
    return df.join(last, on, "left").withColumn(value, F.coalesce("_v", F.lit(default))).drop("_v")


def distinct_of(rows: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct (key, value) of rows whose key is in keys.

    One sort by both columns tells a key's repeated values and serves the join, which only asks whether a key is there: a task
    holds no table of all distinct rows, which aggregations would hold twice, before and after they merge.
    """
    along = Window.partitionBy(key).orderBy(value)
    same = F.col(value).eqNullSafe(F.lag(value).over(along)) & (F.row_number().over(along) > 1)
    return rows.select(key, value, same.alias("_same")).where("not _same").select(key, value).join(keys, key, "left_semi")


def merge_crosswalks(key: str, *sources: DataFrame) -> DataFrame:
    """Union of crosswalks in which a later source's row replaces an earlier one's for the same key."""
    parts = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    others = [c for c in sources[0].columns if c != key]
    return out.groupBy(key).agg(F.max(F.struct("_p", *others)).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in others))


def source_key(c: str, delimiter: str = " | ") -> Column:
    """The first part of a delimited source value."""
    return F.substring_index(c, delimiter, 1)


def flag_in(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """`name`: whether the key is among `keys`."""
    return df.join(keys.select(on).distinct().withColumn("_f", F.lit(True)), on, "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_f")


def attach_labels(meta: DataFrame, mapping: DataFrame, labels: DataFrame, splits: DataFrame, scan: str = "scan", study: str = "study_id") -> DataFrame:
    """One row for each scan with what mapping, labels and splits know of it; what isn't known stays null."""
    one = lambda df, key: df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_o")).select(key, "_o.*")
    return one(meta, scan).join(one(mapping, scan), scan, "left").join(one(labels, study), study, "left").join(one(splits, study), study, "left")


def text_disagreements(a: DataFrame, b: DataFrame, on: str, text: str) -> DataFrame:
    """Keys whose text in a isn't part of that in b."""
    return a.select(on, F.col(text).alias("_a")).join(b.select(on, F.col(text).alias("_b")), on).where(~F.contains(F.col("_b"), F.col("_a"))).select(on)


def key_overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """How many distinct keys both have, only a, and only b."""
    both = a.select(on, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(on, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return both.agg(F.sum(F.col("_a") * F.col("_b")).alias("both"), F.sum(F.col("_a") * (1 - F.col("_b"))).alias("only_a"), F.sum((1 - F.col("_a")) * F.col("_b")).alias("only_b"))


def dedup_guarded(df: DataFrame, key: str, order: list[Column], split: str = "split") -> DataFrame:
    """The first row of each key; raises if a key's rows lie in different splits."""
    crossing = df.groupBy(key).agg(F.count_distinct(split).alias("_n")).where("_n > 1")
    if not crossing.isEmpty():
        raise ValueError(f"{crossing.count()} values of {key} lie in several splits")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def drop_repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    once = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, key, "left_semi")


def drop_conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key has one value in each of the columns."""
    odd = df.groupBy(key).agg(*(F.count_distinct(c).alias(f"_{c}") for c in columns)).where(" or ".join(f"`_{c}` > 1" for c in columns))
    return df.join(odd.select(key), key, "left_anti")


def link_greedy(reports: DataFrame, orders: DataFrame, max_days: int = 10) -> DataFrame:
    """Reports (report_id, patient, report_time) linked one to one with orders (order_id, patient, order_time) of the same
    patient, at most max_days before the report: reports in order of time and id, each takes the nearest order that none has
    taken (ties: the earlier, then the smaller id). report_id, order_id, delta_days.

    That order and choice put all pairs in one order, and a pair is taken if none before it shares its report or order. So in
    rounds every pair that is the first of both its report and its order is taken, and what shares either with it goes, until
    none is left: as the loop would, with a patient of any size. Pairs meet in buckets of days. A report_id that repeats for a
    patient is linked once; rows with a null id, patient or time aren't linked; empty: none.
    """
    width = max_days + 1
    day = lambda c: F.unix_date(F.to_date(c))
    bucket = F.floor(day("report_time") / width)
    asks = reports.select("patient", "report_id", "report_time", F.explode(F.array(bucket - 1, bucket)).alias("_bucket"))
    offers = orders.select("patient", "order_id", "order_time", F.floor(day("order_time") / width).alias("_bucket"))
    pairs = asks.join(offers, ["patient", "_bucket"]).withColumn("delta_days", F.datediff("report_time", "order_time").cast("long")).where(F.col("delta_days").between(0, max_days))
    pairs = pairs.where("report_id is not null and order_id is not null").select("patient", "report_id", "order_id", F.struct("report_time", "report_id", "delta_days", "order_time", "order_id").alias("place"))
    pairs, links = written(pairs), None
    while not pairs.isEmpty():
        of_report, of_order = (pairs.groupBy("patient", c).agg(F.min("place").alias("place")) for c in ("report_id", "order_id"))
        both = written(of_report.join(of_order, ["patient", "place"]))
        links = both if links is None else links.unionByName(both)
        for c in ("report_id", "order_id"):
            pairs = pairs.join(both.select("patient", c), ["patient", c], "left_anti")
        pairs = written(pairs)
    links = pairs if links is None else links
    return links.select("report_id", "order_id", "place.delta_days")


def exclude_contaminated(df: DataFrame, key: str, train_elsewhere: DataFrame, test_elsewhere: DataFrame, split: str = "split") -> DataFrame:
    """split becomes 'remove' for train rows that another set tests on, and for other rows that another set trains on."""
    df = flag_in(flag_in(df, test_elsewhere, key, "_t"), train_elsewhere, key, "_n")
    bad = F.when(F.col(split) == "train", F.col("_t")).otherwise(F.col("_n"))
    return df.withColumn(split, F.when(bad, F.lit("remove")).otherwise(F.col(split))).drop("_t", "_n")
