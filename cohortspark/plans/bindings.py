"""The roles of the data model, played by the provided tables; and the same as SQL common table expressions.

The tables lack some attributes that operators need (who is absent, which rows are censored, which set another cohort tests
on). Arithmetic on ids plays these, on both sides; no query uses it to read less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    tenth = F.col("o_custkey") % 10
    split = F.when(tenth < 8, "train").when(tenth == 8, "valid").otherwise("test")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("anchor_time"), split.alias("split"))


def measured(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Measurements by the ids of their concepts, known or not."""
    items = read(spark, d, "lineitem").where(only).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    df = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return df.select(F.col("o_custkey").alias("person_id"), F.col("l_partkey").alias("concept_id"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("event_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"))


def known(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Rows of known concepts with vocabulary and code. A short window leaves few rows: it comes first, or all measurements are
    shuffled once more."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("vocabulary"), F.col("p_brand").alias("code"))
    return df.join(parts, "concept_id")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    return known(measured(spark, d), spark, d).select("person_id", "vocabulary", "code", "concept_id", "value", "event_time", "event_id")


def visits(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    end = F.max(F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.to_date("l_shipdate")))
    return df.groupBy(F.col("o_orderkey").alias("interval_id"), F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("start_date")).agg(end.alias("end_date"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("vocabulary"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(part, brand, level 1) and (part, type, level 2); ancestors are numbers above the parts'."""
    part = read(spark, d, "part")
    brand = (F.substring_index("p_brand", "#", -1).cast("long") + 1_000_000).alias("ancestor")
    kind = (F.ascii("p_type") * 100 + F.length("p_type") + 2_000_000).cast("long").alias("ancestor")
    one = part.select(F.col("p_partkey").alias("descendant"), brand, F.lit(1).alias("level"))
    return one.unionByName(part.select(F.col("p_partkey").alias("descendant"), kind, F.lit(2).alias("level")))


def persons(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    race = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 8527).when(F.col("c_mktsegment") == "BUILDING", 8516).when(F.col("c_mktsegment") == "FURNITURE", 8515).when(F.col("c_mktsegment") == "HOUSEHOLD", 8557).otherwise(0)
    return read(spark, d, "customer").select(k.alias("person_id"), F.when(k % 10 != 0, F.date_add(F.lit("1930-01-01").cast("date"), (k % 20000).cast("int"))).alias("birth_time"), F.when(k % 20 != 0, 1950).alias("year_of_birth"), F.when(n % 3 == 0, 8507).when(n % 3 == 1, 8532).otherwise(0).alias("gender_concept_id"), F.when(n % 2 == 0, 38003563).when(n % 5 != 0, 38003564).alias("ethnicity_concept_id"), race.alias("race_concept_id"), n.alias("site"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")
    a, b = F.least(F.lit(0.999), F.col("n_chars") / 20000.0), (F.col("doc_id") * 7919 % 1000) / 1000.0
    rows = docs.select(F.col("doc_id").alias("patient_id"), F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.col(t).alias("label"), F.lit(m).alias("model"), p.alias("prob")) for t in ("quality", "toxic") for m, p in (("A", a), ("B", b))))).alias("x"))
    return rows.select("patient_id", "x.*")


def slices(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, d, "embeddings").select(F.col("label").cast("string").alias("scan"), i.alias("slice_idx"), F.col("embedding").alias("vector"), "vec_id")


def notes(spark: SparkSession, d: str) -> DataFrame:
    flat = F.translate("text", "\r\n", "  ")
    half = F.floor(F.char_length(flat) / 2).cast("int")
    text = F.concat(F.lit("FINDINGS: "), F.substring(flat, F.lit(1), half), F.lit(" IMPRESSION: "), F.substring(flat, half + 1, F.char_length(flat)), F.lit(" SUMMARY CODE 3"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("note_id"), text.alias("note"))


ANCHORS = "anchors AS (SELECT o_orderkey AS study_id, o_custkey AS person_id, o_orderdate AS anchor_time, CAST(o_orderdate AS DATE) AS anchor_date, CASE WHEN o_custkey % 10 < 8 THEN 'train' WHEN o_custkey % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM orders)"
MEASUREMENT = "measurement AS (SELECT o_custkey AS person_id, p_type AS vocabulary, p_brand AS code, p_partkey AS concept_id, l_quantity AS value, l_shipdate AS event_time, CAST(l_shipdate AS DATE) AS event_date, l_orderkey * 10 + l_linenumber AS event_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
MET = f"{ANCHORS}, {MEASUREMENT}, met AS (SELECT m.*, a.study_id, a.split, a.anchor_date, a.anchor_time, date_diff('day', event_date, anchor_date) AS days_before FROM measurement m JOIN anchors a USING (person_id))"
VISITS = "visits AS (SELECT o_orderkey AS interval_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS start_date, max(CASE WHEN l_shipdate > o_orderdate THEN CAST(l_shipdate AS DATE) END) AS end_date FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
EDGES = "edges AS (SELECT p_partkey AS descendant, CAST(split_part(p_brand, '#', 2) AS BIGINT) + 1000000 AS ancestor, 1 AS level FROM part UNION ALL SELECT p_partkey, CAST(ascii(p_type) * 100 + length(p_type) + 2000000 AS BIGINT), 2 FROM part)"
PERSONS = "persons AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 10 <> 0 THEN DATE '1930-01-01' + CAST(c_custkey % 20000 AS INT) END AS birth_time, CASE WHEN c_custkey % 20 <> 0 THEN 1950 END AS year_of_birth, CASE c_nationkey % 3 WHEN 0 THEN 8507 WHEN 1 THEN 8532 ELSE 0 END AS gender, CASE WHEN c_nationkey % 2 = 0 THEN 38003563 WHEN c_nationkey % 5 <> 0 THEN 38003564 END AS ethnicity, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 8527 WHEN 'BUILDING' THEN 8516 WHEN 'FURNITURE' THEN 8515 WHEN 'HOUSEHOLD' THEN 8557 ELSE 0 END AS race, c_nationkey AS site FROM customer)"
PREDICTIONS = "preds AS (SELECT doc_id AS patient_id, task, label, model, prob FROM (SELECT doc_id, least(0.999, n_chars / 20000.0) AS a, (doc_id * 7919 % 1000) / 1000.0 AS b, quality, toxic FROM documents JOIN labels USING (doc_id)), LATERAL (VALUES ('quality', quality, 'A', a), ('quality', quality, 'B', b), ('toxic', toxic, 'A', a), ('toxic', toxic, 'B', b)) AS t(task, label, model, prob))"
SLICES = "slices AS (SELECT CAST(label AS VARCHAR) AS scan, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slice_idx, embedding AS vector, vec_id FROM embeddings)"
NOTES = "notes AS (SELECT doc_id AS note_id, 'FINDINGS: ' || substr(flat, 1, length(flat) // 2) || ' IMPRESSION: ' || substr(flat, length(flat) // 2 + 1) || ' SUMMARY CODE 3' AS note FROM (SELECT doc_id, translate(text, chr(13) || chr(10), '  ') AS flat FROM documents))"
