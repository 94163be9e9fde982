import corpus_pipeline
from cohortspark.llm import langid, mixing, toxicity
from cohortspark.llm.common import read, saved
from pyspark.sql import functions as F

from .test_jaccard_join import brute_set


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(saved(stage(spark, kept[-1], sf), "t"))
        assert kept[-1].columns == columns
    start, clean, spoken, distinct, mixed = kept
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    toxic = toxicity.score(start, toxicity.fit(start, read(spark, sf, "labels"))).where("predicted = 1")
    assert ids(clean) == ids(start) - ids(toxic)
    none = langid.identify(clean, langid.fit(clean)).where("lang_pred = 'und'")
    assert ids(spoken) == ids(clean) - ids(none)

    texts = {r.doc_id: brute_set(r.text, 5) for r in spoken.collect()}
    left, near = ids(distinct), lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    order = sorted(texts)
    group = {i: i for i in order}
    for i in order:
        for j in order:
            if j < i and texts[i] and texts[j] and near(texts[i], texts[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert left == {i for i in order if group[i] == i}

    want = {r.doc_id: r.taken for r in mixing.mix_sources(distinct).collect() if r.taken}
    words = {r.doc_id: r.w for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    assert words == want

    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(r.n for r in packed.where("start = 0").select(F.col("doc_tokens").alias("n")).collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
