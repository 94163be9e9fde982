"""Running sums and exact quantiles of ordered values, where no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit


def score_part(c: Column, width: float = 1 / 256) -> Column:
    """A number that never falls as a score rises: its logit in steps of width, about 55 / width values at most. Scores beyond
    0..1 are in the outermost ones, NaN in the last."""
    return F.floor(logit(c.cast("double"), 1e-12) / width).cast("int")


def value_part(c: Column, width: float = 1 / 256) -> Column:
    """The same of any number: the logarithm of its size, with its sign; NaN in the last."""
    x = c.cast("double")
    return F.when(F.isnan(x), 2**31 - 1).otherwise((F.signum(x) * F.floor(F.least(F.log1p(F.abs(x)), F.lit(710.0)) / width)).cast("int"))


def cumulated(t: DataFrame, by: list[str], key: str, sums: list[str], part: Column) -> DataFrame:
    """t with c_before and c_all for every c of sums: its sum over the rows of the same `by` with a smaller key, and over all.

    t has one row of each `by` (nulls are a group) and key (not null); part never falls as the key rises. Sums of parts make the
    sum that a part starts from, which goes to its rows as a row before them, so a task orders a part, not a group. A part that
    is large all the same is sorted with spilling. Empty: empty.
    """
    rows = t.withColumn("_part", part)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    whole = Window.partitionBy(*by)
    parts = rows.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in sums))
    heads = parts.select(*by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums), *(F.sum(c).over(whole).alias(f"{c}_all") for c in sums))
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("_head"), key).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({f"{c}_before": F.sum(c).over(inside) for c in sums} | {f"{c}_all": F.first(f"{c}_all").over(inside) for c in sums})
    return both.where("_head = 0").drop("_part", "_head")


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A row for each `by` with exact quantiles (name: share), between neighbours by their distance; nulls don't count, and a
    group without values has no row (with no `by`: a row of nulls)."""
    t = cumulated(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), by, "_v", ["_n"], value_part(F.col("_v")))
    found = {}
    for name, share in at.items():
        place = F.lit(share) * (F.col("_n_all") - 1)
        holds = lambda k: F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n")), F.col("_v")))
        low, high = holds(F.floor(place)), holds(F.ceil(place))
        rest = F.max(place - F.floor(place))
        found[name] = F.when(low == high, low).otherwise(low + (high - low) * rest)
    return t.groupBy(*by).agg(*(c.alias(n) for n, c in found.items()))


#: Microseconds of a part of time.
WEEK = 7 * 86_400_000_000


def neighbours(rows: DataFrame, by: str, key: str, value: str, width: int = WEEK, own: bool = True) -> DataFrame:
    """rows with _before, the last value that isn't null at or before the row's key (a long) among the rows of the same `by`, and
    _after, the first at or after it; without `own` before and after it (and no two rows of a `by` have the same key). No two
    rows of a `by` with a value have the same key.

    Keys are cut into parts of `width`. The last and first value of each part are carried on over the parts, a row a part, and go
    to the part's rows as a row at its ends, so a task orders a part, not a `by`.
    """
    rows = rows.withColumn("_part", F.expr(f"{key} div {width}"))
    at = F.when(F.col(value).isNotNull(), F.col(key))
    parts = rows.groupBy(by, "_part").agg(F.max_by(value, at).alias("_end_last"), F.min_by(value, at).alias("_end_first"))
    along = Window.partitionBy(by).orderBy("_part")
    heads = parts.select(by, "_part", F.last("_end_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_end_last"), F.first("_end_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_end_first"))
    both = rows.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)), allowMissingColumns=True)
    inside, valued = Window.partitionBy(by, "_part"), F.col(value).isNull()  # at equal keys the row with the value comes first
    upto = lambda end, order: F.last(F.when(F.col("_head") == 1, F.col(end)).otherwise(F.col(value)), True).over(inside.orderBy(F.desc("_head"), order, valued).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    both = both.withColumns({"_before": upto("_end_last", F.asc(key)), "_after": upto("_end_first", F.desc(key))})
    return both.where("_head = 0").drop("_head", "_part", "_end_last", "_end_first")
