"""The corpus pipeline: toxicity, language, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. What a stage decides takes effect: rejected documents go, and later models and statistics don't see them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, mixing, packing, toxicity
from .common import read, saved, text_batches, unused
from .queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is at or above the threshold of their language. Null and empty texts are scored as
    empty; repeated rows and null ids are judged one by one; further columns stay, whatever their names; an empty table gives
    an empty one."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = unused(docs, "__toxicity")
    return text_batches(docs).withColumn(score, toxicity.scored(model)).where(F.col(score) < 0.5).drop(score)


def speak(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null texts, texts without a letter); a missing `lang` becomes the one found.

    Where no language can be learned, as no document has a lang, texts with a letter stay as they are. Further columns stay,
    whatever their names; an empty table gives an empty one.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = unused(docs, "__languages")
    out = text_batches(docs).withColumn(found, langid.identified(model)).where(F.size(found) > 0)
    return out.withColumn("lang", F.coalesce("lang", F.col(found)[0]["lang"])).drop(found)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that Jaccard links of five-word shingles at 0.8 join; documents without words and
    further columns stay; an empty table gives an empty one."""
    return jaccard_join.deduplicated(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: texts cut to the words taken, documents taken twice as two rows. Documents without words go;
    null is a source like others; further columns stay; an empty table gives an empty one."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 ids; a row for each piece, with where its ids lie; null texts are empty, repeated rows documents of
    their own; an empty table gives none."""
    packed = packing.pack_documents(docs, tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("language ID", speak), ("n-gram Jaccard join", distinct), ("mixing sources to target weights", mix), ("packing", pack)]

#: A convolutional classifier can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = saved(docs, "stage")
    return docs
