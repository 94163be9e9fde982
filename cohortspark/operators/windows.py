"""Joins of anchor rows with what happened around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import neighbours

#: Days of a bucket at most, if the window has not more than 32 such.
LONG_DAYS = 1500


def days_before(anchor: str = "anchor_time", event: str = "event_time") -> Column:
    """Calendar days from the event to the anchor."""
    return F.datediff(F.col(anchor), F.col(event))


def window_join(events: DataFrame, anchors: DataFrame, max_days: int, cap_col: str | None = None, bucket_days: int | None = None) -> DataFrame:
    """Events of the same person on days 1..max_days before each anchor, with `days_before` (day 0 isn't in).

    events: person_id, event_time and more; anchors: study_id, person_id, anchor_time and more. cap_col: a column of anchors
    that lowers max_days for its row (0 gives no events).

    Days are cut into buckets of bucket_days, each anchor is repeated for those it reaches, and the bucket is a second join key:
    a partner is met in exactly one bucket, few rows meet in vain, and a person with very many rows is many keys. Without
    bucket_days they are as long as the window, but at least a month and at most LONG_DAYS or a 32nd of the window.
    bucket_days=0: none.
    """
    if bucket_days is None:
        bucket_days = max(30, min(max_days, max(LONG_DAYS, max_days // 32)))
    reach = F.lit(max_days) if cap_col is None else F.least(F.lit(max_days), F.col(cap_col))
    keys = ["person_id"]
    if bucket_days:
        day = lambda c: F.unix_date(F.to_date(F.col(c)))
        bucket = lambda d: F.floor(d / bucket_days)
        events = events.withColumn("_bucket", bucket(day("event_time")))
        anchors = anchors.where(reach >= 1).withColumn("_bucket", F.explode(F.sequence(bucket(day("anchor_time") - reach), bucket(day("anchor_time") - 1))))
        keys.append("_bucket")
    joined = events.join(anchors, keys).drop("_bucket")
    return joined.withColumn("days_before", days_before()).where(F.col("days_before").between(F.lit(1), reach))


def window_overrides(df: DataFrame, codes: DataFrame | None, domains: DataFrame | None, default: tuple[int, int]) -> DataFrame:
    """df (vocabulary, code, domain, days_before) kept where days_before lies in the row's window: that of its code
    (code, min_days, max_days), else of its domain (domain, min_days, max_days), else the default."""
    low, high = [F.lit(default[0])], [F.lit(default[1])]
    for table, key in ((domains, "domain"), (codes, "code")):
        if table is not None:
            df = df.join(table.select(key, F.col("min_days").alias(f"_{key}_min"), F.col("max_days").alias(f"_{key}_max")), key, "left")
            low.insert(0, F.col(f"_{key}_min"))
            high.insert(0, F.col(f"_{key}_max"))
    df = df.where(F.col("days_before").between(F.coalesce(*low), F.coalesce(*high)))
    return df.drop("_domain_min", "_domain_max", "_code_min", "_code_max")


#: Numbers of days below 2 ** LEVELS hold all dates.
LEVELS = 23


def dyadic_cover(first: str, last: str, levels: int = LEVELS) -> Column:
    """The days first..last (longs below 2 ** levels) as array<struct<level, at>>: at most two ranges of each level l, of the days
    at * 2**l up to (at + 1) * 2**l - 1, which are disjoint and together are just these days. None if last is before first."""
    a, b = f"shiftright({first} + shiftleft(1L, l) - 1, l)", f"shiftright({last} + 1, l)"
    pieces = f"array(if({a} < {b} and {a} % 2 = 1, struct(l as level, {a} as at), null), if({a} < {b} and {b} % 2 = 1, struct(l as level, {b} - 1 as at), null))"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), l -> {pieces})), p -> p is not null)")


def encompassing_interval(anchors: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each anchor (one row a study) with the interval (interval_id, person_id, start_date, end_date; a null end is open) of its
    person that holds its day, the latest start of several (then the largest id); anchors without one go.

    An interval is cut into dyadic ranges of days, a day lies in one range of each level, and person and range are the key, so
    anchors and intervals meet only where one holds the other. Of a range's intervals only the latest is kept, before the join,
    so an anchor meets at most one row a level, however many intervals its person has or leaves open. Both joins are shuffled:
    Spark takes an anchor's rows of all levels for as large as its one row in the file, and would broadcast them.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    names = ["start_date", "interval_id", *(c for c in intervals.columns if c not in ("person_id", "start_date", "interval_id"))]
    low, high = anchors.agg(F.min(day("anchor_time")), F.max(day("anchor_time"))).first()
    low, high = (0, 0) if low is None else (low, high)
    levels = (high - low + 1).bit_length()  # of the days that anchors have; the rest of an interval meets none
    first, last = F.greatest(day("start_date"), F.lit(low)) - low, F.least(F.coalesce(day("end_date"), F.lit(high)), F.lit(high)) - low
    ranges = intervals.where("person_id is not null and start_date is not null").select("person_id", F.struct(*names).alias("_i"), first.cast("long").alias("_first"), last.cast("long").alias("_last"))
    ranges = ranges.select("person_id", "_i", F.explode(dyadic_cover("_first", "_last", levels)).alias("_r")).groupBy("person_id", "_r.level", "_r.at").agg(F.max("_i").alias("_i"))
    own = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("_day").cast("long"), level).alias("at")))
    asks = anchors.select("study_id", "person_id", (day("anchor_time") - low).alias("_day")).select("study_id", "person_id", F.inline(own))
    best = asks.join(ranges.hint("merge"), ["person_id", "level", "at"]).groupBy("study_id", "person_id").agg(F.max("_i").alias("_i"))
    return anchors.join(best.hint("merge"), ["study_id", "person_id"]).select(*anchors.columns, *(F.col(f"_i.{c}").alias(c) for c in names))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str, tolerance_days: float) -> DataFrame:
    """Each left row (left_id, by, left_time) with the nearest right row (right_id, by, right_time) of the same key within the
    tolerance, ties to the earlier time and the smaller id; unmatched left rows stay with nulls.

    Both are stacked, and the last right row is carried forward and the next one backward in time: no join, however many pairs
    the key has, and a key with very many rows is as many tasks as it has weeks.
    """
    rest = [c for c in left.columns if c not in (by, "left_time")]
    rows = right.where(F.col(by).isNotNull()).groupBy(by, F.col("right_time").alias("_t")).agg(F.min(right_id).alias("_v"))
    asks = left.select(by, F.col("left_time").alias("_t"), F.struct(*rest).alias("_l"))
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("_us", F.unix_micros(F.col("_t").cast("timestamp")))
    both = both.withColumn("_v", F.when(F.col("_l").isNull(), F.struct(F.col("_t").alias("time"), F.col("_v").alias("id"))))
    met = neighbours(both, by, "_us", "_v").where("_l is not null")
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.time").cast("timestamp")) - F.col("_us"))
    near = lambda c: F.when(gap(c) <= int(tolerance_days * 86_400_000_000), gap(c))
    met = met.withColumns({"_gb": near("_before"), "_ga": near("_after")})
    best = F.when(F.col("_gb").isNotNull() & (F.col("_ga").isNull() | (F.col("_gb") <= F.col("_ga"))), F.col("_before")).when(F.col("_ga").isNotNull(), F.col("_after"))
    met = met.withColumn("_best", F.when(F.col(by).isNotNull(), best))
    columns = {by: F.col(by), "left_time": F.col("_t"), **{c: F.col(f"_l.{c}") for c in rest}}
    return met.select(*(columns[c].alias(c) for c in left.columns), F.col("_best.time").alias("right_time"), F.col("_best.id").alias(right_id))


def asof_backward(labels: DataFrame, values: DataFrame, by: str, value: str) -> DataFrame:
    """Each label row (by, label_id, time) with the latest value (by, time, value) at or before it; null if there is none (a null
    value is none).

    Both are stacked and the last value is carried forward in time order: no join, however many pairs the key has, and a key
    with very many rows is as many tasks as it has weeks. Of several values at a time the largest counts.
    """
    rows = values.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, "time").agg(F.max(value).alias("_v"))
    asks = labels.select(by, "time", F.struct("label_id").alias("_l"))
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("_us", F.unix_micros(F.col("time").cast("timestamp")))
    met = neighbours(both, by, "_us", "_v").where("_l is not null")
    return met.select("_l.label_id", by, "time", F.when(F.col(by).isNotNull(), F.col("_before")).alias(value))
