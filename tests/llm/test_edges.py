"""Edges of the contract: letters, null ids, hot groups of repeated rows, huge components, clashing names."""

import base64
import hashlib
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import common, langid, mixing, packing, queries, sharding, topk, toxicity, warc


@pytest.mark.parametrize("text,has", [("½", False), ("²①Ⅷ", False), ("12_ 3", False), ("́", False), ("½ a", True), ("9é", True), ("ª", True), ("語", True), ("", False)])
def test_letters(text, has):
    assert langid.has_letter(text) == has == any(map(str.isalpha, text))


def test_numbers_that_are_no_letters_have_no_language(spark, documents):
    df = documents([(i, "ka lo mi ren", "aa") for i in range(20)] + [(50, "½ ² ① Ⅷ"), (51, "½ ka")])
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[50] == "und" and got[51] == "aa"


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", F.coalesce(queries.fold(5) == 0, F.lit(False)).alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {None: False, **{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2)}}


def test_a_repeated_id_sends_one_row_to_the_driver(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *rest: seen.append(texts))
    rows = [(7, f"text {i:03}") for i in range(300)] + [(8, "other"), (8, None)]
    toxicity.fit(documents(rows), spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int"))
    assert seen == [["text 000", "other"]]


def test_gradients_are_the_losss_slopes():
    r = np.random.default_rng(1)
    model = toxicity.ConvolutionalClassifier.new()
    words = toxicity.split_words(["alpha beta gamma delta", "beta alpha", "", "gamma gamma alpha epsilon"])
    y, w, kept = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1]), np.ones(len(words.distinct), bool)
    model.out_bias = 0.1
    for name in ("table", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.table *= 5
    model.table[-1] = 0
    model.filters = {k: v.astype(np.float64) for k, v in model.filters.items()}
    model.bias = {k: v.astype(np.float64) + 0.2 for k, v in model.bias.items()}

    def loss():
        z = np.maximum(model.pooled(words)[0], 0) @ model.out + model.out_bias
        return float(np.sum(w * np.log1p(np.exp(np.where(y == 1, -1, 1) * z))) / len(y))

    # one step with a huge memory moves each parameter by rate * gradient / sqrt(memory)
    big, rate = 1e12, 1.0
    parameters = {"out": model.out, **{f"w{k}": v for k, v in model.filters.items()}, **{f"b{k}": v for k, v in model.bias.items()}, "table": model.table}
    before = {k: v.copy() for k, v in parameters.items()}
    memory = {k: np.full_like(v, big) for k, v in parameters.items()} | {"out_bias": big}
    model.step(words, y, w, rate, memory, kept)
    told = {k: (before[k] - v) * np.sqrt(big) for k, v in parameters.items()}
    for k, v in parameters.items():
        v[...] = before[k]
    model.out_bias = 0.1
    checked = 0
    for k, v in parameters.items():
        flat, t = v.reshape(-1), told[k].reshape(-1)
        places = np.flatnonzero(t) if k == "table" else np.arange(len(flat))
        for p in r.choice(places, min(25, len(places)), replace=False):
            old, h = flat[p], 1e-5
            flat[p] = old + h
            up = loss()
            flat[p] = old - h
            down = loss()
            flat[p] = old
            assert abs((up - down) / (2 * h) - t[p]) < 1e-3 + 0.02 * abs(t[p]), (k, p, (up - down) / (2 * h), t[p])
            checked += 1
    assert checked > 60


def test_repeated_rows_are_dealt_over_groups(spark, documents):
    rows = [(None, None)] * 3000 + [(5, "same words here")] * 3000
    import public_tokenizers

    packed = packing.pack_documents(documents(rows).coalesce(2), public_tokenizers.path("byte_bpe_50k.json"), group=500, keep_ids=False)
    assert "repeat" not in packed.columns
    got = packed.select(F.expr("sequence_id div 1099511627776").alias("g"), "sequence_id", "offset", "length").collect()
    groups = np.bincount([r.g for r in got])
    assert len(got) == 6000 and groups.max() < 1200
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_a_mix_doesnt_depend_on_the_order_of_rows(spark, documents):
    rows = [(i % 3, " ".join(f"{x}{k}" for k in range(40)), "en", "s", 1) for i, x in enumerate("abcdefghijkl")] + [(20, "y " * 500, "en", "t", 1)]
    mixes = [sorted((r.doc_id, r.text) for r in mixing.mixed_texts(documents(order), block=8, shard=200).collect()) for order in (rows, rows[::-1])]
    assert mixes[0] == mixes[1] and mixes[0]


def test_components_beyond_64_bits(spark):
    x = {0: [1e30, -3.0], 1: [2e20, 5.5], 2: [-1e25, 1.0], 50: [1.0, -1.0], 3: [1e-3, 9e18]}
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    f = {i: [int(np.floor(256 * c)) for c in v] for i, v in x.items()}
    clip = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    got = topk.top_inner_products(df, df.where("vec_id % 50 = 0"), 3).collect()
    for q in (0, 50):
        want = sorted(((-clip(sum(a * b for a, b in zip(f[q], v))), i) for i, v in f.items() if i != q))[:3]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_shards_are_written_whole(spark, documents, tmp_path):
    rows = [(i % 40 if i % 9 else None, None if i % 11 == 0 else "t" * (i % 50), f"l{i % 3}", "s", 1) for i in range(500)] + [(7, "same", "l", "s", 1)] * 3
    df = documents(rows).withColumns({"shard": F.lit("old"), "Slot": F.lit(9), "row": F.lit(1), "doc": F.lit("d")})
    sharding.write_shards(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "row", "doc", "shard", "slot", "curve"])
    got = back.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got), key=key) == sorted(rows, key=key)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in got)


def hilbert_place(point, bits):
    """The place of a cell by walking down the curve: each level visits the 8 sub-cubes in Gray order, in its own orientation,
    given by an entry corner and a direction."""
    n, mask = len(point), (1 << len(point)) - 1
    gray = lambda i: i ^ (i >> 1)
    turn = lambda x, k: ((x >> k) | (x << (n - k))) & mask
    entry, direction, place = 0, 0, 0
    for level in range(bits - 1, -1, -1):
        corner = sum(((p >> level) & 1) << i for i, p in enumerate(point))
        corner = turn(corner ^ entry, (direction + 1) % n)
        w = next(i for i in range(1 << n) if gray(i) == corner)
        place = (place << n) | w
        start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
        trailing = lambda i: (i ^ (i + 1)).bit_length() - 1
        step = 0 if w == 0 else trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n
        k = (direction + 1) % n
        entry ^= ((start << k) | (start >> (n - k))) & mask
        direction = (direction + step + 1) % n
    return place


def test_shards_against_an_order_of_documents(spark, documents):
    """All documents in one list by curve, bucket and tie, cut by row counts; the curve itself is a walk of neighbours."""
    assert sorted(hilbert_place((x, y, z), 2) for x in range(4) for y in range(4) for z in range(4)) == list(range(64))
    rows = [(i * 7 % 301, "w" * (i * i % 3000), f"l{i % 4}", f"s{i % 6}", 1) for i in range(700)]
    got = sharding.shard_documents(documents(rows), 24).collect()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    n = len(order)
    assert [r.shard for r in order] == [k * 24 // n for k in range(n)]
    cells = [(r.lang_level, r.source_level, r.length_level) for r in order]
    curve = {c: r.curve for c, r in zip(cells, order)}
    assert sorted(set(cells), key=lambda c: curve[c]) == [c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]]
    assert len(set(curve.values())) == len(curve)


def test_warc_against_a_table_of_pages(spark):
    pages = [(i, f"http://h/{i}", None if i % 13 == 0 else f"<p>{i % 37}</p>é" * (i % 5)) for i in range(400)]
    folder = warc.archive_folder(spark)
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder), folder, payloads=False).collect()
    last = {}
    for i, _, html in pages:
        last[html or ""] = i
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = last[html or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == want


def test_archives_of_no_pages_and_of_long_ones(spark):
    folder = warc.archive_folder(spark)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, folder), folder).count() == 0
    long = spark.createDataFrame([(i, "u", chr(97 + i) * (3 << 20), "x") for i in range(6)], "page_id long, url string, html string, payload_digest string")
    got = warc.read_archives(warc.write_archives(long, folder), folder).collect()
    assert sorted((r.page_id, r.payload_bytes, bytes(r.payload[:1])) for r in got) == [(i, 3 << 20, bytes([97 + i])) for i in range(6)]


def test_stages_with_odd_tables(spark, documents, tmp_path):
    labels = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'fine'}{(i * k) % 91}" for k in range(30)), "en", "s", 1) for i in range(40)] + [(None, None), (None, "fine day for all of us"), (60, ""), (61, "½"), (62, "fine " * 20_000), (62, "fine " * 20_000)]
    df = documents(rows).withColumns({c: F.lit("mine") for c in ("__toxicity", "__languages", "size", "row", "copy", "doc", "_source", "node", "region", "root", "__n")})
    for docs in (df, df.where("false"), df.withColumn("lang", F.lit(None).cast("string"))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.columns
            docs = common.saved(stage(spark, docs, labels), "t")
            assert docs.columns == before and docs.where("__toxicity <> 'mine' or __languages <> 'mine' or size <> 'mine'").isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, labels).count() == 0 or not docs.isEmpty()


def test_without_any_lang_texts_with_letters_stay(spark, documents):
    df = documents([(1, "some words"), (2, "12 ½"), (3, None), (4, "")])
    assert [r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, df, "").collect()] == [1]


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                isDefined = staticmethod(lambda: False)

                            return O

                    return S

    with pytest.raises(ValueError):
        common.shared_dir(Fake)


def test_the_entry_module_does_without_the_subpackage(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    try:
        entry = importlib.reload(__spark_entry__)
        assert not entry.HAS_LLM and "op1_warc" not in entry.queries() and len(entry.queries()) > 100
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
