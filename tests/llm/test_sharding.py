import zlib

from pyspark.sql import functions as F

from cohortspark.llm import sharding


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        size = 1 << bits
        df = spark.range(size**n).select(*((F.floor(F.col("id") / size**i) % size).cast("int").alias(f"d{i}") for i in range(n)))
        rows = sorted(sharding.hilbert_index(df, [f"d{i}" for i in range(n)], bits).collect(), key=lambda r: r.curve)
        assert [r.curve for r in rows] == list(range(size**n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[f"d{i}"] - b[f"d{i}"]) for i in range(n)) == 1


def test_shards(spark, documents, tmp_path):
    rows = [(i, "t" * (i % 50) if i % 7 else "copy é", f"l{i % 3}", f"s{i % 5}", 1) for i in range(997)] + [(None, None), (1000, ""), (1001, "x" * 200_000), (3, "tttt"), (3, "tttt")]
    df = documents(rows).withColumns({"shard": F.lit("x"), "curve": F.lit(1)})
    got = sharding.shard_documents(df, 24)
    placed = got.collect()
    counts, slots = {}, {}
    for r in placed:
        counts[r.shard] = counts.get(r.shard, 0) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(placed) == len(rows) and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.curve for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    for r in placed:
        if r.doc_id is None:
            assert (r["size"], r.text_crc32) == (8, 0)
    one = next(r for r in placed if r.doc_id == 0)
    assert (one["size"], one.text_crc32) == (8 + 7, zlib.crc32("copy é".encode()))
    ranges = sharding.shard_ranges(got, ["lang_level", "source_level", "length_level"]).collect()
    assert sum(r.rows for r in ranges) == len(rows)
    sharding.write_shards(documents(rows[:900]), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 900
    assert sharding.shard_documents(documents([]), 24).count() == 0
