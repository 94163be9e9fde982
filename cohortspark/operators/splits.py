"""Splits, folds and samples by seeded hashes of keys: the same rows and seed give the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(key: str | Column, seed: int | Column) -> Column:
    """48 bits of a hash that every engine has, of seed and key: what all draws go by."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(seed.cast("string"), F.lit("|"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def hash_rank(key: str, seed: int, within: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*within).orderBy(drawn(key, seed), key))


def ranked_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, place: from 1 in hash order, of: their number) of the distinct keys, nulls aside. Keys are ranked within 256 parts
    of the hash's range, whose sizes make the offsets, so no task orders all of them."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", drawn(key, seed)).withColumn("_p", F.shiftright("_h", 40).cast("int"))
    parts = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 256 rows at most
    parts = parts.select("_p", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("of"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_before")
    return keys.join(F.broadcast(parts), "_p").select(key, place.alias("place"), "of")


def sample_keys(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """All rows of int(n * fraction) of the n distinct keys, those first in hash order."""
    kept = ranked_keys(df, key, seed).where(F.col("place") <= F.floor(F.col("of") * F.lit(fraction))).select(key)
    return df.join(kept, key, "left_semi")


def stratified_group_split(df: DataFrame, group: str, stratum: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """split for each row, equal for all rows of a group: groups of each stratum in hash order, cut at counts by largest
    remainder, so that they sum to the stratum's groups. A group's stratum is the largest among its rows."""
    groups = df.groupBy(group).agg(F.max(stratum).alias("_s"))
    sizes = groups.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    names = list(fractions)
    floors = [F.floor(F.col("_n") * F.lit(float(fractions[n]))) for n in names]
    rest = [F.round(F.col("_n") * F.lit(float(fractions[n])) - f, 9) for n, f in zip(names, floors)]
    open_ = F.col("_n") - sum(floors[1:], floors[0])
    place = [sum((((other > rest[i]) | ((other == rest[i]) & F.lit(j < i))).cast("int") for j, other in enumerate(rest) if j != i), F.lit(0)) for i in range(len(names))]
    ends, total = [], F.lit(0)
    for i in range(len(names)):
        total = total + floors[i] + (place[i] < open_).cast("int")
        ends.append(total)
    sizes = sizes.select("_s", *(e.alias(f"_e{i}") for i, e in enumerate(ends)))
    ranked = groups.withColumn("_r", hash_rank(group, seed, ["_s"])).join(sizes, "_s")
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(F.col("_r") <= F.col(f"_e{i}"), names[i]).otherwise(split)
    return df.drop("split").join(ranked.select(group, split.alias("split")), group)


def own_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """df with the fold in which its patient is tested. Patients in hash order go to folds by turns, so folds differ by one
    patient at most; rows without a key have none."""
    own = ranked_keys(df, key, seed).select(key, (F.col("place") % k).cast("int").alias("fold"))
    return df.join(own, key, "left")


def fold_role(own: Column, fold: Column, k: int) -> Column:
    """test for the rows of the fold's patients, valid for the next fold's, else train."""
    return F.when(own == fold, "test").when(own == (fold + 1) % k, "valid").otherwise("train")


def patient_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """A row for each row and fold, with its role there; rows without a key are train in all."""
    rows = own_folds(df, key, k, seed).withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("role", fold_role(F.col("_own"), F.col("fold"), k)).drop("_own")


def hash_split(df: DataFrame, key: str, cuts: dict[str, int], seed: int) -> DataFrame:
    """split by the key's hash percentile; cuts: percent of each, in order."""
    p, split, upto = drawn(key, seed) % 100, None, 0
    for name, percent in cuts.items():
        upto += percent
        split = F.when(p < upto, name) if split is None else split.when(p < upto, name)
    return df.withColumn("split", split)


def random_split(df: DataFrame, key: str, seed: int) -> DataFrame:
    """60/20/20 of the keys in hash order; null for rows without a key."""
    ranks = ranked_keys(df, key, seed)
    share = F.col("place") * 100
    split = F.when(share <= F.col("of") * 60, "train").when(share <= F.col("of") * 80, "valid").otherwise("test")
    return df.drop("split").join(ranks.select(key, split.alias("split")), key, "left")


def holdout(df: DataFrame, key: str, percent: int, seed: int, split: str = "split") -> DataFrame:
    """The first percent of the train rows' keys in hash order become valid."""
    ranks = ranked_keys(df.where(F.col(split) == "train"), key, seed)
    chosen = ranks.where(F.col("place") * 100 <= F.col("of") * percent).select(key, F.lit(True).alias("_out"))
    return df.join(chosen, key, "left").withColumn(split, F.when((F.col(split) == "train") & F.col("_out"), "valid").otherwise(F.col(split))).drop("_out")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """weight: one over the number of rows with the label."""
    counts = df.groupBy(label).agg((1 / F.count(F.lit(1))).alias("weight"))
    return df.join(counts, label)


def balanced_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int) -> DataFrame:
    """About per_class rows of each label, with replacement: a row's copies are Poisson with mean per_class * weight, drawn from
    its key's hash."""
    mean = F.col("weight") * per_class
    u = (drawn(key, seed) % (1 << 30) + 0.5) / (1 << 30)
    state = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    step = lambda s, k: F.when(s.c < u, F.struct((s.p * mean / (s.n + 1)).alias("p"), (s.c + s.p * mean / (s.n + 1)).alias("c"), (s.n + 1).alias("n"))).otherwise(s)
    copies = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(20), F.ceil(mean * 4).cast("int"))), state, step, lambda s: s.n)
    return balanced_weights(df, label).withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
