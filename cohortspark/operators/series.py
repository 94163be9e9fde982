"""Slice vectors: series of a scan, their positions, lengths and pools."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import numbered
from .running import cumulated, neighbours


def build_series(slices: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row for each scan in meta (scan): the vectors (scan, slice_idx, vector) in order of slice_idx."""
    if meta is not None:
        slices = slices.join(meta.select("scan").distinct(), "scan", "left_semi")
    rows = slices.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("slice_idx", "vector"))).alias("s"))
    return rows.select("scan", F.col("s.vector").alias("vectors"), F.size("s").alias("n_slices"))


def series_report(slices: DataFrame, meta: DataFrame) -> DataFrame:
    """How many scans were written and how many skipped because meta doesn't know them."""
    have = meta.select("scan").distinct().withColumn("_m", F.lit(True))
    return slices.select("scan").distinct().join(have, "scan", "left").agg(F.count("_m").alias("written"), F.count(F.when(F.col("_m").isNull(), 1)).alias("skipped"))


#: Slice numbers of a chunk of a scan.
CHUNK = 256


def contextualize(slices: DataFrame) -> DataFrame:
    """Each vector (scan, slice_idx: one row each, vector) with its difference to the one before and to the one after; zeros at the
    ends. A scan is cut into chunks, to which the vectors at their borders are carried, so no task orders a long scan."""
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    zero = F.transform("vector", lambda x: x * 0)
    rows = slices.withColumn("_key", F.col("slice_idx").cast("long"))
    met = neighbours(rows, "scan", "_key", "vector", CHUNK, own=False)
    return met.select(*(F.concat("vector", F.coalesce(minus("vector", "_before"), zero), F.coalesce(minus("vector", "_after"), zero)).alias(c) if c == "vector" else F.col(f"`{c}`") for c in slices.columns))


def ranked(slices: DataFrame) -> DataFrame:
    """slices (scan, slice_idx: one row each) with _i, the place in the scan from 0, and _n, the scan's slices, counted in chunks."""
    found = cumulated(slices.withColumns({"_key": F.col("slice_idx").cast("long"), "_one": F.lit(1)}), ["scan"], "_key", ["_one"], F.expr(f"_key div {CHUNK}"))
    return found.withColumns({"_i": F.coalesce("_one_before", F.lit(0)), "_n": F.col("_one_all")}).select(*(F.col(f"`{c}`") for c in slices.columns), "_i", "_n")


def add_position(slices: DataFrame, thickness: str | None = None) -> DataFrame:
    """position: index times thickness over the larger of the last such value and 1, or index / (n - 1)."""
    df = ranked(slices)
    at = F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)) if thickness is None else F.col(thickness) * F.col("_i") / F.greatest(F.col(thickness) * (F.col("_n") - 1), F.lit(1.0))
    return df.withColumn("position", at.cast("double")).drop("_i", "_n")


def fix_slices(slices: DataFrame, n: int, strategy: str = "fix", seed: int = 0) -> DataFrame:
    """Series (scan, vectors, mask) of exactly n from slices: the middle n, or a seeded choice in order, of longer scans; shorter ones
    are padded with zero vectors. mask: 1 for vectors of the scan. Places are found before anything is collected, so no more
    than n vectors of a scan meet."""
    rows = ranked(slices)
    if strategy == "fix":
        start = F.greatest(F.lit(0), F.expr(f"(_n - {n}) div 2"))
        rows = rows.where((F.col("_i") >= start) & (F.col("_i") < start + n))
    else:
        drawn = rows.withColumns({"_h": F.xxhash64(F.lit(seed), "scan", "_i"), "_two": F.lit(1)})
        rows = cumulated(drawn, ["scan"], "_h", ["_two"], F.shiftright("_h", 54)).where(F.coalesce("_two_before", F.lit(0)) < n)
    kept = rows.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("_i", "vector"))).alias("s")).select("scan", F.col("s.vector").alias("vectors"))
    pad = F.greatest(F.lit(0), F.lit(n) - F.size("vectors"))
    zero = F.transform(F.element_at("vectors", 1), lambda x: x * 0)
    return kept.select("scan", F.concat("vectors", F.array_repeat(zero, pad)).alias("vectors"), F.concat(F.array_repeat(F.lit(1), F.size("vectors")), F.array_repeat(F.lit(0), pad)).alias("mask"))


def fix_length(series: DataFrame, n: int, strategy: str = "fix", seed: int = 0) -> DataFrame:
    """Series (scan, vectors) of exactly n: the middle n, or a seeded choice in order, of longer ones; shorter ones are padded
    with zero vectors. mask: 1 for vectors of the scan."""
    size = F.size("vectors")
    if strategy == "fix":
        cut = F.slice("vectors", F.greatest(F.lit(1), F.floor((size - n) / 2).cast("int") + 1), n)
    else:
        order = F.sort_array(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("scan"), i).alias("h"), i.alias("i"))))
        chosen = F.array_sort(F.transform(F.slice(order, 1, n), lambda x: x.i))
        cut = F.transform(chosen, lambda i: F.element_at("vectors", i + 1))
    zero = F.transform(F.element_at("vectors", 1), lambda x: x * 0)
    pad = F.greatest(F.lit(0), F.lit(n) - size)
    mask = F.concat(F.array_repeat(F.lit(1), F.least(size, F.lit(n))), F.array_repeat(F.lit(0), pad))
    return series.select("scan", F.concat(F.when(size <= n, F.col("vectors")).otherwise(cut), F.array_repeat(zero, pad)).alias("vectors"), mask.alias("mask"))


def first_slices(slices: DataFrame, n: int) -> DataFrame:
    """The first n rows of each scan."""
    return ranked(slices).where(F.col("_i") < n).drop("_i", "_n")


def pool(slices: DataFrame, how: str = "mean") -> DataFrame:
    """(scan, dim, value): the mean or maximum of each dimension over a scan's real slices."""
    f = {"mean": F.avg, "max": F.max}[how]
    return slices.select("scan", F.posexplode("vector").alias("dim", "x")).groupBy("scan", "dim").agg(f(F.col("x").cast("double")).alias("value"))


def drop_zero_series(slices: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Slices of scans that aren't listed in bad (scan) and have a component other than the last that isn't zero."""
    any_ = F.exists(F.slice("vector", 1, F.greatest(F.size("vector") - 1, F.lit(0))), lambda x: x != 0)
    good = slices.groupBy("scan").agg(F.max(any_).alias("_g")).where("_g").select("scan")
    out = slices.join(good, "scan", "left_semi")
    return out if bad is None else out.join(bad.select("scan").distinct(), "scan", "left_anti")


def with_group_count(df: DataFrame, key: str, name: str = "n_slices") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))


def intensity_window(c: str | Column, center: float, width: float) -> Column:
    """An array clipped to center ± width / 2 and scaled to 0..1."""
    low, high = center - width / 2, center + width / 2
    return F.transform(c, lambda x: (F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) / (high - low))


def intensity_channels(c: str, windows: list[tuple[float, float]]) -> Column:
    return F.array(*(intensity_window(c, *w) for w in windows))


def expand_slices(scans: DataFrame, n: str = "num_slices") -> DataFrame:
    """A row for every slice index below the scan's number of slices."""
    return scans.where(F.col(n) > 0).withColumn("slice_idx", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))


def vector_index(vectors: DataFrame, id_col: str = "id") -> tuple[DataFrame, int]:
    """(row: from 0 in order of the id, id, split, label, prob and the vector, one row each; how many ids came twice, of which a
    warning tells). Rows are numbered within range parts of the ids, whose sizes make the offsets."""
    twice = vectors.groupBy(id_col).count().where("count > 1").count()
    if twice:
        warnings.warn(f"{twice} ids came more than once; each keeps its least row", stacklevel=2)
    columns = [c for c in ("split", "label", "prob", "vector") if c in vectors.columns]
    one = vectors.groupBy(id_col).agg(F.min(F.struct(*columns)).alias("_v")).select(id_col, "_v.*")
    return numbered(one, [F.col(id_col)], "row"), twice
