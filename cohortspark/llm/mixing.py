"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, saved, shuffle_partitions, small, text_key

#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block; every shard of a source is cut into blocks of equal length, at most this.
BLOCK = 32
#: Words of a shard of a source, in which blocks are chosen, and the most shards of a source.
SHARD, MOST_SHARDS = 1 << 22, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, words: one row each) with weight, target and rate (target / words; 0 for none).

    The targets sum to share * all words in proportion to the weights; none exceeds most * its words, and what is above goes
    to the others by weight until none is above. In order of most * words / weight, a source is cut off exactly if what is
    left, shared among it and those after it, would be above: one pass of windows over the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("words"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    df = df.withColumns({
        "_level": F.col("_cap") / F.col("weight"),
        "_left": F.lit(float(share)) * F.sum("words").over(whole) - F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    open_ = F.col("_left") / F.col("_weights") <= F.col("_level")
    df = df.withColumn("_level_all", F.max(F.when(open_, F.col("_left") / F.col("_weights"))).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_level_all"), F.col("_cap")))
    df = df.withColumn("target", target).withColumn("rate", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0)))
    return df.drop("_cap", "_level", "_left", "_weights", "_level_all")


def apportion(df: DataFrame, group: list[str], key: list[str], weight: str, seats: str, name: str) -> DataFrame:
    """df with `name`, the seats that Sainte-Laguë gives each row of a group: the group's `seats` go one by one to the row
    with the highest quotient weight / (2 * seats so far + 1), ties to the smaller key.

    For any number of seats N over M rows, a row ends within fair * M / (2 * N) + 1 of its fair share, so every row has the
    seats below that for certain, and only the few around it (under three a row, and half a row's count over all) are ranked.
    """
    kept, w = df.columns, Window.partitionBy(*group)
    fair = F.when(F.col("_sum") > 0, F.col(seats) * F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_fair") * F.col("_rows") / (2 * F.col(seats)) + 1).otherwise(F.lit(0.0))
    df = df.withColumns({"_sum": F.sum(weight).over(w), "_rows": F.count(F.lit(1)).over(w)}).withColumn("_fair", fair)
    df = df.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_fair") - slack)).cast("long")).withColumn("_high", F.ceil(F.col("_fair") + slack).cast("long"))
    df = df.withColumn("_open", F.col(seats) - F.sum("_low").over(w))
    one = df.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    quotient = F.col(weight) / (2 * F.col("_seat") - 1)
    one = one.withColumn("_rank", F.row_number().over(w.orderBy(quotient.desc_nulls_last(), *key)))
    won = F.col("_seat").isNotNull() & (F.col(weight) > 0) & (F.col("_rank") <= F.col("_open"))
    return one.groupBy(*kept, "_low").agg(F.sum(won.cast("long")).alias("_won")).select(*kept, (F.col("_low") + F.col("_won")).alias(name))


def plan_mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(placed documents, blocks) of a mix of documents (doc_id, source, size: words, mark: a hash of the text, copy: from 0
    among documents of equal id, size and mark).

    A document lies at words [start, start + size) of its source's shard, in the order of a seeded hash. A shard's words are
    cut into blocks of equal length, at most `block` words; its integer quota of blocks comes from two rounds of Sainte-Laguë,
    over the sources and over the shards of a source. Each block is taken quota div blocks times, and the blocks first in a
    seeded order once more. blocks: _source, _shard, block, block_start, block_end, times, before (words taken before it), taken_all.

    A source has as many shards as it needs for `shard` words each (65,536 at most), so no task orders more than a shard's
    documents and blocks, however large the source and however often a document is repeated. Only tables of sources meet in one task.
    """
    docs = docs.withColumn("_source", text_key("source"))
    sources = docs.groupBy("_source", "source").agg(F.sum("size").alias("words"))
    sources = checkpointed(source_targets(sources, weights, share, most).withColumn("_shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("words") / shard))).cast("long")))
    placed = docs.join(small(sources.select("_source", F.col("words").alias("source_size"), "target", "rate", "_shards")), "_source")
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "mark", "copy"), F.col("_shards"))).drop("_shards")
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "mark", "copy"), "doc_id", "size", "mark", "copy")
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    cells = placed.groupBy("_source", "_shard", "rate").agg(F.sum("size").alias("_words")).where("_words > 0")
    cells = checkpointed(cells.withColumn("_blocks", F.ceil(F.col("_words") / block)).withColumn("_fair", F.col("rate") * F.col("_blocks")))
    by_source = cells.groupBy("_source").agg(F.sum("_fair").alias("fair")).withColumn("seats", F.round(F.sum("fair").over(Window.partitionBy())).cast("long"))
    by_source = apportion(by_source, [], ["_source"], "fair", "seats", "quota").select("_source", "quota")
    cells = apportion(cells.join(by_source, "_source"), ["_source"], ["_shard"], "_fair", "quota", "_quota")
    cells = checkpointed(cells.select("_source", "_shard", "_words", "_blocks", F.least(F.col("_quota"), F.floor(F.lit(float(most)) * F.col("_blocks"))).alias("_quota")))

    n = shuffle_partitions(docs.sparkSession)  # an explicit count: AQE would merge the few rows that become many
    blocks = cells.repartition(n, "_source", "_shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cell = Window.partitionBy("_source", "_shard")
    rank = F.row_number().over(cell.orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_shard", "block"), "block"))
    times = F.expr("_quota div _blocks") + F.when(rank <= F.col("_quota") % F.col("_blocks"), 1).otherwise(0)
    blocks = blocks.withColumns({"times": times, "block_start": F.expr("block * _words div _blocks"), "block_end": F.expr("(block + 1) * _words div _blocks")})
    before = F.coalesce(F.sum(F.col("times") * (F.col("block_end") - F.col("block_start"))).over(cell.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum(F.col("times") * (F.col("block_end") - F.col("block_start"))).over(cell)
    blocks = blocks.withColumns({"before": before, "taken_all": every}).select("_source", "_shard", "block", "block_start", "block_end", "times", "before", "taken_all")
    placed = placed.join(small(cells.select("_source", "_shard", "_words", "_blocks")), ["_source", "_shard"], "left")
    return placed, blocks.hint("merge")  # Spark's estimate misses the explosion and would broadcast all blocks


def block_at(position: str) -> Column:
    """The block of a shard's word: the last one that starts at or before it."""
    return F.expr(f"(({position} + 1) * _blocks - 1) div _words")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How many words a mix takes of each of documents (doc_id, text, source); see plan_mix for options.

    Returns doc_id, source, size (words; null text: 0), source_size, target (its source's) and taken (words, repeats
    counted, at most twice the size). Null is a source of its own, the last. Documents without words take none; repeated
    rows are documents of their own; an empty table gives none. The same rows and seed give the same mix.

    A document's taken words are what the shard's blocks take up to its end less what they take up to its start, so only the
    block at its start is looked up; no document meets all of its blocks.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    slim = saved(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")  # repeats are counted before they move
    slim = slim.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows")
    placed, blocks = plan_mix(slim, **options)
    cell = Window.partitionBy("_source", "_shard").orderBy("start")
    full = placed.where("size > 0").withColumn("block", block_at("start")).join(blocks, ["_source", "_shard", "block"])
    upto = F.col("before") + F.col("times") * (F.col("start") - F.col("block_start"))
    full = full.withColumn("_upto", upto)
    full = full.withColumn("taken", F.coalesce(F.lead("_upto").over(cell), F.col("taken_all")) - F.col("_upto"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.select(*out).unionByName(none.select(*out))


def numbered_copies(rows: DataFrame, same: list[str]) -> DataFrame:
    """rows (with `row`, a number that is written) with copy, from 0 among the rows equal in `same`. They are ranked in the parts
    that they were written in, whose counts make the offsets, so no task ranks all of very many copies."""
    rows = rows.withColumns({"_same": F.struct(*same), "_part": F.shiftright("row", 33)})
    counts = rows.groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    counts = counts.select("_same", "_part", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("row")) - 1
    return rows.join(counts, ["_same", "_part"]).withColumn("copy", F.col("_before") + rank).drop("_same", "_part", "_before")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents (doc_id, text, source, and whatever columns stand beside them) with the taken words.

    A document taken nowhere goes. Where its blocks are taken unequally often, the n-th copy holds the words that are taken
    at least n times, with the white space after them; a document taken whole keeps its text as it is. `text` is replaced,
    n_chars is counted anew if there is one, and the other columns stay, whatever their names. Copies are rows with the same
    doc_id. Null texts have no words, null is a source of its own, repeated rows are documents of their own, and an empty table
    gives none.
    """
    row = F.monotonically_increasing_id()  # fixed by writing it
    docs = saved(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), row.alias("row")), "mix-texts")
    slim = numbered_copies(docs.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "size", "mark", "row"), ["doc_id", "source", "size", "mark"])
    placed, blocks = plan_mix(slim, **options)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block_at("start"), block_at("(start + size - 1)"))))
    pieces = pieces.join(blocks, ["_source", "_shard", "block"])
    low, high = F.greatest(F.col("start"), F.col("block_start")) - F.col("start"), F.least(F.col("start") + F.col("size"), F.col("block_end")) - F.col("start")
    pieces = pieces.select("row", F.struct(low.alias("low"), high.alias("high"), F.col("times")).alias("piece"))
    pieces = pieces.groupBy("row").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.min("piece.times").alias("least"), F.max("piece.times").alias("most"))
    out = docs.join(pieces.where("most > 0"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    out = out.withColumn("words", F.when(F.col("copy") > F.col("least"), F.regexp_extract_all("doc.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))))
    cut = F.transform(F.filter("pieces", lambda p: p.times >= F.col("copy")), lambda p: F.concat_ws("", F.slice("words", p.low.cast("int") + 1, (p.high - p.low).cast("int"))))
    out = out.withColumn("text", F.when(F.col("copy") <= F.col("least"), F.col("doc.text")).otherwise(F.concat_ws("", cut)))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.schema["doc"].dataType.names))
