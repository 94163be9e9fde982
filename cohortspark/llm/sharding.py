"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bits of a dimension: 3 dimensions of 5 bits make at most 32,768 cells, so tables of cells have a proven bound.
BITS = 5


def log_level(c: Column, bits: int = BITS) -> Column:
    """Half-octave level of a count (null: 0), the highest level open above."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.coalesce(c, F.lit(0)) + 1) * 1.5)).cast("int")


def category_level(c: Column, bits: int = BITS) -> Column:
    """A level of a category by its hash: equal values share one (null has its own hash)."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0null"))), F.lit(1 << bits)).cast("int")


def hilbert_index(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """df with the place of the cell `dims` (ints below 2**bits) on the Hilbert curve, in integer arithmetic of columns.

    Each step is a projection of its own, so that the optimizer doesn't multiply the expressions into each other.
    """
    n, x = len(dims), [f"_h{i}" for i in range(len(dims))]
    df = df.withColumns({x[i]: F.col(d).cast("int") for i, d in enumerate(dims)})
    for b in range(bits - 1, 0, -1):  # undo the rotations from the coarsest level to the finest
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            flip = F.col(x[i]).bitwiseAND(q) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            new = {x[0]: F.when(flip, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if i:
                new[x[i]] = F.when(flip, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, n):  # Gray code
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_turn", turn)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("_turn")) for c in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index * 2 + F.shiftright(F.col(c), b).bitwiseAND(1)
    return df.withColumn(name, index).drop("_turn", *x)


def hilbert_shards(rows: DataFrame, dims: list[str], n_shards: int, tie: list[str], buckets: int = 4096, bits: int = BITS) -> DataFrame:
    """rows ordered along the Hilbert curve over `dims` and cut into n_shards runs whose row counts are at most one apart.

    rows: quantised dims (ints below 2**bits, not null; at most 2**(bits * dims) cells) and `tie`, columns that order rows of
    one cell. It is read twice, so pass a written table. Adds curve (long), shard (int) and slot (long, from 0 in its shard).

    No global sort: cells are counted, the at most 2**(bits * dims) cells are ordered along the curve, and inside a cell
    rows are dealt over `buckets` by a hash of `tie`, so a cell with a third of all rows is ranked by thousands of tasks.
    Rows equal in all of `tie` share a bucket, so give repeated rows a number in it.
    An empty table gives an empty one.
    """
    keys = [*dims, "_bucket"]
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cells = hilbert_index(counts.groupBy(*dims).agg(F.sum("_n").alias("_n")), dims, bits)
    upto = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell: the bound is above
    cells = cells.select(*dims, "curve", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy(*dims).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(cells), dims)
    starts = starts.select(*keys, "curve", "_total", (F.col("_start") + F.col("_in")).alias("_first"))
    rank = F.col("_first") + F.row_number().over(Window.partitionBy(*keys).orderBy(*tie)) - 1
    out = rows.join(starts, keys).withColumn("_rank", rank)
    out = out.withColumn("shard", F.expr(f"cast((_rank * {n_shards}) div _total as int)"))
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", F.col("_rank") - first).drop("_bucket", "_rank", "_total", "_first")


DIMS = ["lang_level", "source_level", "length_level"]


def quantised(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), category_level(F.col("lang")).alias("lang_level"), category_level(F.col("source")).alias("source_level"), log_level(F.char_length(text)).alias("length_level"))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """documents (doc_id, text, lang, source) over n_shards by language, source and length; law: row counts.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32 (null text: that of no bytes), the quantised dims lang_level,
    source_level and length_level, curve, shard, slot. One pass over the texts; only these columns are shuffled. Null and
    repeated doc_ids are rows of their own, repeated rows are dealt over the buckets; other columns are ignored; an empty table gives none.
    """
    rows = quantised(docs)
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))  # repeats are counted before they move
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return hilbert_shards(saved(rows, "shard-rows"), DIMS, n_shards, ["doc_id", "text_crc32", "size", "copy"]).drop("copy")


def shard_ranges(assigned: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard the rows, bytes and the range of every dimension: what a reader needs to skip files."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """docs written as one folder a shard, rows in slot order, with the columns slot and curve.

    Rows are told by a number that is written with them, so null and repeated doc_ids lose and multiply nothing. Columns of
    docs named shard, slot or curve are replaced; an empty table gives no folders.
    """
    numbered = saved(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "shard-docs")
    rows = saved(quantised(numbered.select("row", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "text", "lang", "source"))), "row"), "shard-rows")
    placed = hilbert_shards(rows, DIMS, n_shards, ["doc_id", "text_crc32", "size", "row"]).select("row", "shard", "slot", "curve")
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "slot", "curve")]
    out = numbered.join(placed, "row").select(*kept, "shard", "slot", "curve")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
