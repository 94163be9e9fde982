"""Repeated rows are dealt over shards and buckets; clashing and dotted names stay."""

import random

from pyspark.sql import functions as F

from cohortspark.llm import jaccard_join, mixing, sharding


def test_repeats_are_many_shards(spark, documents):
    df = documents([(None, "a b c d e", None, "s")] * 2000 + [(1, "x y", None, "t")])
    slim = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))
    placed, _ = mixing.plan_mix(mixing.numbered_copies(slim, ["doc_id", "source", "size", "mark"]), shard=100)
    sizes = [r["count"] for r in placed.where("source = 's'").groupBy("_shard").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 90 and max(sizes) < 60
    taken = mixing.mix_sources(df, shard=100)
    assert taken.count() == 2001 and taken.where("taken > 2 * size").isEmpty()
    mixed = mixing.mixed_texts(df, shard=100)
    words = lambda t: t.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words(mixed) == taken.agg(F.sum("taken")).first()[0]


def test_copies_are_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2]), r.choice("ab")) for _ in range(500)]
    df = spark.createDataFrame([(*x, (i % 5 << 33) + i) for i, x in enumerate(rows)], "id long, s string, row long")
    got = mixing.numbered_copies(df, ["id", "s"]).collect()
    for key in set(rows):
        assert sorted(x.copy for x in got if (x.id, x.s) == key) == list(range(rows.count(key)))
    assert len(got) == 500


def test_mix_agrees_however_rows_are_parted(spark, documents):
    r = random.Random(2)
    rows = [(i % 40, " ".join(r.choice("abc") for _ in range(r.randint(0, 4))), None, r.choice("st")) for i in range(400)]
    df = documents(rows)
    kept = lambda t: sorted(map(tuple, t.select("doc_id", "source", "size", "target", "taken").collect()), key=repr)
    assert kept(mixing.mix_sources(df.repartition(3), shard=50)) == kept(mixing.mix_sources(df.orderBy("text").coalesce(2), shard=50))


def test_repeats_are_many_buckets(spark, documents, monkeypatch):
    df = documents([(5, "same text", "aa", "s")] * 1000 + [(i, f"t {i}", "aa", "s") for i in range(50)])
    seen = {}
    real = sharding.hilbert_shards
    monkeypatch.setattr(sharding, "hilbert_shards", lambda rows, dims, n, tie, **k: seen.update(tie=tie, rows=rows) or real(rows, dims, n, tie, **k))
    got = sharding.shard_documents(df, 7)
    buckets = seen["rows"].where("doc_id = 5").select(F.pmod(F.xxhash64(*seen["tie"]), F.lit(4096)).alias("b")).distinct().count()
    assert buckets > 700
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(counts) == 1050 and max(counts) - min(counts) <= 1 and "copy" not in got.columns
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_clashing_and_dotted_names_stay(spark, documents):
    text = "one two three four five six seven eight nine ten"
    df = documents([(1, text), (2, text), (3, text + " eleven"), (3, text + " eleven"), (None, "other words that stand alone here"), (5, None)])
    df = df.withColumns({"__kept_id": F.lit(1), "__kept_hash": F.lit("x"), "__rows": F.lit(2), "a.b": F.lit(3), "__place": F.lit(9)})
    out = jaccard_join.deduplicated(df, width=3, percent=80)
    assert out.columns == df.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 5]
    mixed = mixing.mixed_texts(df)
    assert mixed.columns == df.columns and mixed.where("`a.b` <> 3 or __rows <> 2").isEmpty() and mixed.count() > 0
