"""Queries of cohort construction, splits, descriptions, quality, sources and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import anchors as A
from ..operators import cohort as K
from ..operators import describe as D
from ..operators import quality as Q
from ..operators import splits as P
from ..sources import io
from . import bindings as B
from .registry import query, rounded


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget')) OR contains(lower(p_name), 'bolt')")
def match_text(spark: SparkSession, d: str) -> DataFrame:
    return K.match_text(B.read(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["RED", "widget"], ["bolt"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE upper(c_mktsegment) IN ('HOUSEHOLD', 'FURNITURE')")
def keep_in(spark, d):
    keys = spark.sql("SELECT * FROM VALUES ('household '), ('Furniture'), ('Furniture') AS t(c_mktsegment)")
    return K.keep_in(B.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), keys, "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)")
def drop_in(spark, d):
    keys = B.read(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return K.drop_in(B.read(spark, d, "customer").select("c_custkey"), keys.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS c_custkey")), "c_custkey")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def json_eq(spark, d):
    return K.json_eq(B.events(spark, d), "props", "$.k", "69").select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 950")
def in_ranges(spark, d):
    return K.in_ranges(B.read(spark, d, "part"), {"p_size": (10, 20), "p_retailprice": (900, 950)}).select("p_partkey")


_TOKEN = "CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN ' censored' WHEN 3 THEN '1.0' WHEN 4 THEN NULL ELSE 'no' END"


def _tokens(spark, d):
    return B.anchors(spark, d).withColumn("token", F.expr(_TOKEN.replace("o_orderkey", "study_id"))).withColumnRenamed("anchor_time", "study_time")


@query("SELECT o_orderkey AS study_id, o_orderkey % 6 IN (0, 3) AS label FROM orders WHERE o_orderkey % 6 NOT IN (2, 4)")
def parse_label(spark, d):
    return A.labelled(_tokens(spark, d), "token").select("study_id", "label")


@query("SELECT o_orderkey AS study_id, CAST(CAST(CASE WHEN o_orderkey % 3 = 0 THEN l ELSE o_orderdate END AS DATE) AS VARCHAR) AS anchor_day FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CASE WHEN o_orderkey % 3 = 0 THEN l ELSE o_orderdate END IS NOT NULL")
def resolve_time(spark, d):
    items = B.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("l"))
    df = B.read(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    df = df.withColumns({"one": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")), "two": F.when(F.col("o_orderkey") % 3 == 0, F.col("l"))})
    return A.resolve_time(df, ["one", "two"]).select(F.col("o_orderkey").alias("study_id"), F.to_date("anchor_time").cast("string").alias("anchor_day"))


@query("SELECT o_orderkey AS study_id, CAST(CAST(o_orderdate - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS diagnostic, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS prognostic, CAST(CAST(o_orderdate - INTERVAL 3 DAY AS DATE) AS VARCHAR) AS shifted FROM orders")
def add_anchor(spark, d):
    df, day = _tokens(spark, d), F.to_date("anchor_time").cast("string")
    one = A.add_anchor(df, "diagnostic").select("study_id", day.alias("diagnostic"))
    two = A.add_anchor(df).select("study_id", day.alias("prognostic"))
    return one.join(two, "study_id").join(A.add_anchor(df, shift_days=3).select("study_id", day.alias("shifted")), "study_id")


@query("SELECT o_orderkey AS study_id, o_orderkey % 6 IN (0, 3) AS label, CAST(CAST(o_orderdate - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 6 NOT IN (2, 4) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def labels_from_columns(spark, d):
    present = B.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person_id"))
    return A.labels_from_columns(_tokens(spark, d), "token", present, "diagnostic").select("study_id", "label", F.to_date("prediction_time").cast("string").alias("day"))


@query("SELECT o_orderkey AS study_id, CASE o_orderkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE WHEN 5 THEN FALSE ELSE o_orderstatus = 'F' END AS label FROM orders")
def coalesced_labels(spark, d):
    status = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.when(F.col("o_orderstatus") == "F", "T").otherwise("F").alias("second"))
    return A.coalesced_labels(_tokens(spark, d).join(status, "study_id"), "label", "token", "second").select("study_id", "label")


@query("SELECT p_partkey, p_type || '/' || p_brand AS code FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def keep_domains(spark, d):
    return K.keep_domains(B.read(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("code")), ["economy", "Small"])


@query("SELECT o_orderkey AS study_id, 'price' AS feature, o_totalprice AS value FROM orders UNION ALL SELECT l_orderkey, 'items', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1")
def concat_blocks(spark, d):
    price = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.lit("price").alias("feature"), F.col("o_totalprice").alias("value"))
    items = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study_id")).agg(F.lit("items").alias("feature"), F.count(F.lit(1)).cast("double").alias("value"))
    return K.concat_blocks(price, items)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 20)")
def restrict_to_series(spark, d):
    series = K.in_ranges(B.read(spark, d, "part"), {"p_size": (10, 20)}).select(F.col("p_partkey").alias("l_partkey"))
    instances = B.read(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    return K.restrict(instances, series, B.read(spark, d, "orders").select("o_orderkey"), "l_partkey", "o_orderkey")[1]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def union_cohorts(spark, d):
    o = B.read(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey").unionByName(o.where("o_orderpriority = '5-LOW'").select("o_orderkey"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (3, 7) AND c_acctbal >= 0 AND c_acctbal < 5000")
def filter_cohort(spark, d):
    return K.filter_cohort(B.read(spark, d, "customer"), c_nationkey=[3, 7], c_acctbal_between=(0, 5000)).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(concat_ws(chr(31), CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR))), '00001')")
def search_rows(spark, d):
    return K.search_rows(B.read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "00001").select("s_suppkey")


@query("SELECT l_partkey AS feature, sum(l_quantity) AS value FROM lineitem WHERE l_orderkey = 7 GROUP BY 1 HAVING sum(l_quantity) <> 0")
def patient_features(spark, d):
    long = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study_id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return K.patient_features(long, 7).select("feature", "value")


@query("SELECT patient_id, task, model FROM preds WHERE patient_id % 10 = 9 AND patient_id % 3 = 0 AND patient_id IN (SELECT doc_id FROM labels WHERE toxic = 0)", B.PREDICTIONS)
def eval_subset(spark, d):
    p = B.predictions(spark, d)
    ids = p.select("patient_id").distinct()
    splits = ids.withColumn("split", F.when(F.col("patient_id") % 10 == 9, "test").otherwise("train"))
    sick = B.read(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("patient_id"))
    return K.eval_subset(p, splits, ids.where("patient_id % 3 = 0"), sick, "test").select("patient_id", "task", "model")


@query("SELECT c_custkey, kept, removed FROM (SELECT c_custkey, k, count(*) FILTER (WHERE k) OVER () AS kept, count(*) FILTER (WHERE NOT k) OVER () AS removed FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS k FROM customer)) WHERE k")
def require_series(spark, d):
    have = B.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kept, report = K.require_series(B.read(spark, d, "customer"), have, "c_custkey")
    return kept.select("c_custkey").crossJoin(F.broadcast(report))  # one row


@query("SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def lookup(spark, d):
    dim = B.read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.lit(2).alias("order"))
    dim = dim.unionByName(dim.withColumns({"n_name": F.lit("old"), "order": F.lit(1)}))
    return K.lookup(B.read(spark, d, "customer"), dim, "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("SELECT k AS a, CASE WHEN k % 3 = 0 THEN 'c' WHEN k % 2 = 0 THEN 'b' ELSE 'a' END AS b FROM (SELECT s_suppkey AS k FROM supplier)")
def merge_crosswalks(spark, d):
    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    return K.merge_crosswalks("a", s.withColumn("b", F.lit("a")), s.where("a % 2 = 0").withColumn("b", F.lit("b")), s.where("a % 3 = 0").withColumn("b", F.lit("c")))


@query("SELECT o_orderkey AS study_id, p_brand FROM orders JOIN (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey")
def crosswalk_join(spark, d):
    items = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("study_id"), "p_brand")
    return K.distinct_of(items, B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id")), "study_id", "p_brand")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS first FROM customer")
def source_key(spark, d):
    value = F.concat_ws(" | ", F.substring_index("c_name", "#", 1), "c_mktsegment")
    return B.read(spark, d, "customer").withColumn("value", value).select("c_custkey", K.source_key("value").alias("first"))


@query("SELECT a.o_orderkey AS study_id, o_orderstatus AS label, CAST(o_custkey % 5 AS INT) AS split FROM orders a WHERE o_orderstatus IN ('F', 'O')")
def merge_labels(spark, d):
    o = B.read(spark, d, "orders")
    mapping = o.select(F.col("o_orderkey").alias("study_id"))
    labels = o.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderstatus").alias("label"))
    splits = o.select(F.col("o_orderkey").alias("study_id"), (F.col("o_custkey") % 5).cast("int").alias("split"))
    return A.merge_labels(mapping, labels.unionByName(labels), splits.unionByName(splits))


@query("SELECT scan, study_id, label, split FROM (SELECT CAST(vec_id AS VARCHAR) AS scan, CASE WHEN vec_id % 5 <> 0 THEN vec_id END AS study_id FROM embeddings) LEFT JOIN (SELECT o_orderkey, o_orderstatus AS label FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = study_id LEFT JOIN (SELECT o_orderkey AS k, CAST(o_custkey % 3 AS INT) AS split FROM orders) ON k = study_id")
def attach_labels(spark, d):
    e, o = B.read(spark, d, "embeddings"), B.read(spark, d, "orders")
    meta = e.select(F.col("vec_id").cast("string").alias("scan"), F.lit(1).alias("one"))
    mapping = e.where("vec_id % 5 <> 0").select(F.col("vec_id").cast("string").alias("scan"), F.col("vec_id").alias("study_id"))
    labels = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderstatus").alias("label"))
    splits = o.select(F.col("o_orderkey").alias("study_id"), (F.col("o_custkey") % 3).cast("int").alias("split"))
    return K.attach_labels(meta.unionByName(meta), mapping, labels, splits).select("scan", "study_id", "label", "split")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS flag FROM customer")
def flag_in(spark, d):
    keys = B.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return K.flag_in(B.read(spark, d, "customer"), keys, "c_custkey", "flag").select("c_custkey", "flag")


@query("SELECT doc_id FROM documents WHERE NOT contains(text, text || CASE WHEN doc_id % 4 = 0 THEN '~~' ELSE '' END)")
def text_disagreements(spark, d):
    docs = B.read(spark, d, "documents")
    part = docs.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 4 == 0, "~~").otherwise("")).alias("text"))
    return K.text_disagreements(part, docs.select("doc_id", "text"), "doc_id", "text")


@query("SELECT CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE b AND NOT a) AS BIGINT) AS only_b FROM (SELECT k, k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS a, k IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders))")
def key_overlap(spark, d):
    o = B.read(spark, d, "orders")
    return K.key_overlap(o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '5-LOW'"), "o_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedup_guarded(spark, d):
    o = B.read(spark, d, "orders").withColumn("split", F.col("o_custkey") % 3)
    return K.dedup_guarded(o, "o_custkey", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def drop_repeated(spark, d):
    return K.drop_repeated(B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 2)")
def drop_conflicts(spark, d):
    o = B.read(spark, d, "orders").withColumn("p", F.col("o_orderpriority"))
    two = o.groupBy("o_custkey").agg(F.count_distinct("p").alias("n")).where("n > 2").select("o_custkey")
    return K.drop_conflicts(o, "o_custkey", ["o_orderstatus"]).join(two, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT w.report_id, w.order_id, e.delta_days FROM (SELECT patient, unnest(rs) AS report_id, unnest(os) AS order_id FROM (SELECT patient, arg_max(rs, k) AS rs, arg_max(os, k) AS os FROM walk GROUP BY patient)) w JOIN edges e USING (patient, report_id, order_id)", """RECURSIVE edges AS (SELECT r.user_id AS patient, r.event_id AS report_id, o.event_id AS order_id, date_diff('day', CAST(o.ts AS DATE), CAST(r.ts AS DATE)) AS delta_days, row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.event_id, date_diff('day', CAST(o.ts AS DATE), CAST(r.ts AS DATE)), o.ts, o.event_id) AS k FROM events r JOIN events o USING (user_id) WHERE r.event_type = 'signup' AND o.event_type = 'purchase' AND date_diff('day', CAST(o.ts AS DATE), CAST(r.ts AS DATE)) BETWEEN 0 AND 10),
walk AS (SELECT DISTINCT patient, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS rs, CAST([] AS BIGINT[]) AS os FROM edges UNION ALL SELECT e.patient, e.k, CASE WHEN list_contains(rs, e.report_id) OR list_contains(os, e.order_id) THEN rs ELSE list_append(rs, e.report_id) END, CASE WHEN list_contains(rs, e.report_id) OR list_contains(os, e.order_id) THEN os ELSE list_append(os, e.order_id) END FROM walk w JOIN edges e ON e.patient = w.patient AND e.k = w.k + 1)""")
def link_greedy(spark, d):
    e = B.events(spark, d)
    reports = e.where("event_type = 'signup'").select(F.col("event_id").alias("report_id"), F.col("user_id").alias("patient"), F.col("ts").alias("report_time"))
    orders = e.where("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("patient"), F.col("ts").alias("order_time"))
    return K.link_greedy(reports, orders)


@query("SELECT study_id, CASE WHEN split = 'train' AND study_id % 7 = 0 THEN 'remove' WHEN split <> 'train' AND study_id % 5 = 0 THEN 'remove' ELSE split END AS split FROM anchors", B.ANCHORS)
def exclude_contaminated(spark, d):
    a = B.anchors(spark, d)
    return K.exclude_contaminated(a, "study_id", a.where("study_id % 5 = 0"), a.where("study_id % 7 = 0")).select("study_id", "split")


@query("SELECT s_suppkey, CASE WHEN length(s) >= 8 THEN s ELSE lpad(s, 8, '0') END AS id FROM (SELECT s_suppkey, CAST(s_suppkey * 12345679 AS VARCHAR) AS s FROM supplier)")
def padded_id(spark, d):
    return B.read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 12345679).cast("string").alias("s")).select("s_suppkey", scalars.padded_id("s").alias("id"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def reformat_time(spark, d):
    text = F.concat(F.upper(F.date_format("ts", "dd-MMM-yy hh.mm.ss")), F.lit(".000000 "), F.date_format("ts", "a"))
    return B.events(spark, d).select("event_id", text.alias("t")).select("event_id", scalars.reformat_time("t").alias("shown"))


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS gender, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Unknown' WHEN 'MACHINERY' THEN 'Other' ELSE c_mktsegment END AS race, CASE c_nationkey % 3 WHEN 0 THEN 'Non-Hispanic' WHEN 1 THEN 'Hispanic' ELSE 'Unknown' END AS ethnicity FROM customer")
def source_demographics(spark, d):
    n, s = F.col("c_nationkey") % 3, F.col("c_mktsegment")
    race = F.concat(F.when(s == "HOUSEHOLD", "Declines to State").when(s == "MACHINERY", "Native Hawaiian or Other Pacific Islander").otherwise(s), F.lit(" | x"))
    df = B.read(spark, d, "customer").select("c_custkey", F.when(n == 0, 8507).when(n == 1, 8532).otherwise(0).alias("gender_concept_id"), race.alias("race_source_value"), F.when(n == 0, "Non-Hispanic/Non-Latino | y").when(n == 1, "Hispanic/Latino").otherwise("Unknown").alias("ethnicity_source_value"))
    return scalars.source_demographics(df).select("c_custkey", "gender", "race", "ethnicity")


@query("SELECT vec_id, 'PE' || vec_id AS person, '2010-01-0' || (vec_id % 9 + 1) AS time FROM embeddings")
def scan_parts(spark, d):
    key = F.concat(F.lit("PE"), "vec_id", F.lit("_2010-01-0"), F.col("vec_id") % 9 + 1, F.lit(".nii.gz"))
    return B.read(spark, d, "embeddings").select("vec_id", key.alias("k")).select("vec_id", scalars.scan_parts("k").alias("p")).select("vec_id", "p.person", "p.time")


@query("SELECT o_orderkey AS study_id, o_orderkey / 1440.0 AS tte_days, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 1 END AS event FROM orders")
def survival(spark, d):
    df = _tokens(spark, d).withColumn("minutes", F.col("study_id").cast("double"))
    return A.survival(df, "minutes", "token").select("study_id", "tte_days", "event")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return D.value_counts(B.read(spark, d, "orders"), "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return D.repeated_keys(B.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(linked) AS linked, count(*) - count(linked) AS missing, round(avg(linked), 6) AS mean_offset, round(stddev_pop(linked), 6) AS sd_offset, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM (SELECT CASE WHEN l_quantity > 10 THEN l_quantity END AS linked, CAST(l_shipdate AS DATE) AS day FROM lineitem)")
def link_summary(spark, d):
    df = B.read(spark, d, "lineitem").withColumn("linked", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    return rounded(D.link_summary(df, "linked", "linked", "l_shipdate"), "mean_offset", "sd_offset").withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT o_orderpriority AS task, split, count(*) FILTER (WHERE o_orderstatus = 'F') AS positive, count(*) FILTER (WHERE o_orderstatus = 'O') AS negative, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS censored, count(*) AS total, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS positive_percent, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS negative_percent, round(100.0 * count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) / count(*), 6) AS censored_percent FROM orders JOIN anchors ON study_id = o_orderkey GROUP BY 1, 2", B.ANCHORS)
def label_counts(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderpriority").alias("task"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("label"))
    return rounded(D.label_counts(o.join(B.anchors(spark, d), "study_id")), "positive_percent", "negative_percent", "censored_percent")


@query("SELECT split, o_orderstatus AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM orders JOIN anchors ON study_id = o_orderkey GROUP BY 1, 2", B.ANCHORS)
def distribution_by_split(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderstatus").alias("status"))
    return rounded(D.distribution_by_split(o.join(B.anchors(spark, d), "study_id"), "status"), "percent")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 1 WHEN c_acctbal <= b THEN 2 WHEN c_acctbal <= c THEN 3 ELSE 4 END AS quartile FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)")
def density_quartile(spark, d):
    return D.density_quartile(B.read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "quartile")


_STUDIES = f"{B.ANCHORS}, {B.PERSONS}, studies AS (SELECT a.study_id, a.person_id, a.split, CAST(o_orderstatus = 'F' AS INT) AS y, count(l_partkey) AS total, count(DISTINCT l_partkey) AS codes, CASE WHEN a.study_id % 4 <> 0 THEN o_totalprice END AS tte_days, CASE WHEN a.study_id % 4 <> 0 THEN CAST(o_orderstatus = 'F' AS INT) END AS event, CAST(a.person_id % 90 AS DOUBLE) AS age, CASE WHEN gender = 8532 THEN 'female' ELSE 'male' END AS sex, site, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS key, a.study_id % 3 = 0 AS oldest FROM anchors a JOIN orders ON o_orderkey = a.study_id JOIN persons p ON p.person_id = a.person_id LEFT JOIN lineitem ON l_orderkey = a.study_id GROUP BY ALL)"


def _studies(spark, d):
    items = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study_id")).agg(F.count("l_partkey").alias("total"), F.count_distinct("l_partkey").alias("codes"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("key"))
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice")
    df = B.anchors(spark, d).join(o, "study_id").join(B.persons(spark, d), "person_id").join(items, "study_id", "left").fillna(0, ["total", "codes"])
    known = F.col("study_id") % 4 != 0
    return df.select("study_id", "person_id", "split", "y", "total", "codes", F.when(known, F.col("o_totalprice")).alias("tte_days"), F.when(known, F.col("y")).alias("event"), (F.col("person_id") % 90).cast("double").alias("age"), F.when(F.col("gender_concept_id") == 8532, "female").otherwise("male").alias("sex"), "site", "key", (F.col("study_id") % 3 == 0).alias("oldest"))


@query("SELECT dim, level, count(*) AS n_studies, count(DISTINCT person_id) AS n_patients, round(avg(y), 6) AS event_rate, CAST(sum(y) AS BIGINT) AS n_positive, round(avg(codes), 6) AS mean_codes, round(quantile_cont(codes, 0.5), 6) AS median_codes, round(avg(total), 6) AS mean_total, round(1 - avg(CASE WHEN tte_days IS NOT NULL THEN event END), 6) AS censoring_rate, round(quantile_cont(tte_days, 0.5), 6) AS median_tte, round(avg(age), 6) AS age_mean, round(quantile_cont(age, 0.75) - quantile_cont(age, 0.25), 6) AS age_iqr, round(avg(CAST(sex = 'female' AS INT)), 6) AS frac_female, round(avg(CAST(coalesce(key, 0) = 0 AS INT)), 6) AS key_missing, round(avg(CAST(oldest AS INT)), 6) AS frac_oldest, count(DISTINCT site) AS n_sites, round(max(sites[1]) / CAST(count(*) AS DOUBLE), 6) AS top_site_share FROM (SELECT *, list_sort([count(*) OVER (PARTITION BY dim, level, site)], 'DESC') AS sites FROM (SELECT *, 'all' AS dim, 'all' AS level FROM studies UNION ALL SELECT *, 'split', split FROM studies UNION ALL SELECT *, 'sex', sex FROM studies)) GROUP BY dim, level", _STUDIES)
def describe_slices(spark, d):
    df = D.describe_slices(_studies(spark, d), ["split", "sex"])
    return rounded(df, "event_rate", "mean_codes", "median_codes", "mean_total", "censoring_rate", "median_tte", "age_mean", "age_iqr", "frac_female", "key_missing", "frac_oldest", "top_site_share")


@query("SELECT person_id, count(*) AS n_studies, CASE WHEN count(DISTINCT split) > 1 THEN 'mixed' ELSE min(split) END AS split, CAST(sum(y) AS BIGINT) AS n_positive, min(tte_days) AS first_tte, max(event) AS any_event FROM (SELECT * REPLACE (CASE WHEN study_id % 11 = 0 THEN 'test' ELSE split END AS split) FROM studies) GROUP BY 1", _STUDIES)
def patient_table(spark, d):
    return D.patient_table(_studies(spark, d).withColumn("split", F.when(F.col("study_id") % 11 == 0, "test").otherwise(F.col("split"))))


@query("SELECT count(*) AS n_studies, count(DISTINCT person_id) AS n_patients, round(avg(y), 6) AS event_rate, round(avg(CAST(total > 0 AS INT)), 6) AS measured, round(quantile_cont(tte_days, 0.5), 6) AS median_tte FROM studies", _STUDIES)
def cohort_summary(spark, d):
    long = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("study_id"), F.col("l_quantity").alias("value"))
    return rounded(D.summary(_studies(spark, d), long), "event_rate", "measured", "median_tte")


@query("SELECT split AS level, p_type AS vocabulary, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey JOIN anchors ON study_id = l_orderkey WHERE l_quantity <> 0 GROUP BY 1, 2", B.ANCHORS)
def vocab_shares(spark, d):
    long = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("study_id"), F.col("p_type").alias("vocabulary"), F.col("l_quantity").alias("value"))
    return rounded(D.vocab_shares(long, B.anchors(spark, d).select("study_id", F.col("split").alias("level"))), "share")


@query("SELECT 'split' AS dim, split AS level, CASE WHEN split = 'test' THEN 0.5 END AS auroc FROM (SELECT DISTINCT split FROM anchors)", B.ANCHORS)
def attach_metric(spark, d):
    slices = B.anchors(spark, d).select(F.lit("split").alias("dim"), F.col("split").alias("level")).distinct()
    return D.attach_metric(slices, spark.sql("SELECT 'split' AS dim, 'test' AS level, CAST(0.5 AS DOUBLE) AS value"), "auroc")


@query("SELECT c AS \"column\", CASE c WHEN 'a' THEN 'bigint' ELSE 'string' END AS type, n AS missing, round(100.0 * n / t, 6) AS missing_percent FROM (SELECT count(*) - count(a) AS na, count(*) - count(b) AS nb, count(*) AS t FROM (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS b FROM orders)), LATERAL (VALUES ('a', na), ('b', nb)) AS v(c, n)")
def profile(spark, d):
    df = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("b"))
    return rounded(D.profile(df), "missing_percent")


@query("SELECT r AS rows, c AS columns, nonzero, round(nonzero / (CAST(r AS DOUBLE) * c), 6) AS density, CAST(0 AS BIGINT) AS nan, CAST(0 AS BIGINT) AS inf FROM (SELECT (SELECT count(*) FROM orders) AS r, (SELECT count(*) FROM part) AS c, count(*) AS nonzero FROM (SELECT l_orderkey, l_partkey, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2) WHERE v <> 0)")
def matrix_stats(spark, d):
    """Studies by parts: the shape of the matrix that the long table stands for."""
    long = B.read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_discount").alias("value"))
    return rounded(D.matrix_stats(long, B.read(spark, d, "orders").count(), B.read(spark, d, "part").count()), "density")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def seed_summary(spark, d):
    return rounded(D.seed_summary(B.read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "mean", "sd", digits=4)


@query("SELECT o_custkey AS patient_id, round(avg(o_totalprice), 4) AS prob FROM orders GROUP BY 1")
def mean_by_patient(spark, d):
    return rounded(D.mean_by_patient(B.read(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_totalprice").alias("prob"))), "prob", digits=4)


@query("SELECT o_custkey AS task, max(o_orderkey) AS run FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1")
def latest_run(spark, d):
    runs = B.read(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("run"))
    return D.latest_run(runs, "task", "time").select("task", "run")


@query("SELECT row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) AS place, c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS v FROM customer)")
def rank_runs(spark, d):
    df = B.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    return D.rank_runs(df, "v", "c_custkey").select("place", "c_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def top1_per(spark, d):
    return D.top1_per(B.read(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS n_slices FROM lineitem")
def with_group_count(spark, d):
    from ..operators.series import with_group_count as f

    return f(B.read(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "n_slices")


def _h(seed: int, key: str) -> str:
    """48 bits of md5 of seed and key."""
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 12) AS BIGINT)"


def _ranks(seed: int, key: str, of: str = "anchors") -> str:
    return f"(SELECT {key}, row_number() OVER (ORDER BY {_h(seed, key)}, {key}) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {of}))"


@query(f"SELECT study_id, person_id FROM anchors JOIN {_ranks(3, 'person_id')} USING (person_id) WHERE place <= floor(n * 0.2)", B.ANCHORS)
def sample_keys(spark, d):
    return P.sample_keys(B.anchors(spark, d), "person_id", 0.2, 3).select("study_id", "person_id")


_SHARES = "g AS (SELECT person_id, person_id % 4 AS s FROM anchors GROUP BY 1), n AS (SELECT s, count(*) AS n, floor(n * 0.7) AS f0, floor(n * 0.1) AS f1, floor(n * 0.2) AS f2, round(n * 0.7 - f0, 9) AS r0, round(n * 0.1 - f1, 9) AS r1, round(n * 0.2 - f2, 9) AS r2, n - f0 - f1 - f2 AS o FROM g GROUP BY s), c AS (SELECT s, f0 + CAST((r1 > r0)::INT + (r2 > r0)::INT < o AS INT) AS e0, f1 + CAST((r0 >= r1)::INT + (r2 > r1)::INT < o AS INT) AS e1 FROM n)"


@query(f"SELECT a.study_id, a.person_id, a.person_id % 4 AS stratum, CASE WHEN r <= e0 THEN 'train' WHEN r <= e0 + e1 THEN 'valid' ELSE 'test' END AS split FROM anchors a JOIN (SELECT person_id, s, row_number() OVER (PARTITION BY s ORDER BY {_h(5, 'person_id')}, person_id) AS r FROM g) USING (person_id) JOIN c USING (s)", f"{B.ANCHORS}, {_SHARES}")
def stratified_group_split(spark, d):
    a = B.anchors(spark, d).withColumn("stratum", F.col("person_id") % 4)
    return P.stratified_group_split(a, "person_id", "stratum", {"train": 0.7, "valid": 0.1, "test": 0.2}, 5).select("study_id", "person_id", "stratum", "split")


@query(f"SELECT study_id, person_id, CAST(f AS INT) AS fold, CASE WHEN place % 5 = f THEN 'test' WHEN place % 5 = (f + 1) % 5 THEN 'valid' ELSE 'train' END AS role FROM anchors JOIN {_ranks(42, 'person_id')} USING (person_id), range(5) t(f)", B.ANCHORS)
def patient_folds(spark, d):
    return P.patient_folds(B.anchors(spark, d), "person_id", 5, 42).select("study_id", "person_id", "fold", "role")


@query(f"SELECT study_id, CASE WHEN h < 80 THEN 'train' WHEN h < 85 THEN 'valid' ELSE 'test' END AS split FROM (SELECT study_id, {_h(97, 'person_id')} % 100 AS h FROM anchors)", B.ANCHORS)
def hash_split(spark, d):
    return P.hash_split(B.anchors(spark, d).drop("split"), "person_id", {"train": 80, "valid": 5, "test": 15}, 97).select("study_id", "split")


@query(f"SELECT study_id, CASE WHEN place * 100 <= n * 60 THEN 'train' WHEN place * 100 <= n * 80 THEN 'valid' ELSE 'test' END AS split FROM anchors JOIN {_ranks(1, 'study_id')} USING (study_id)", B.ANCHORS)
def random_split(spark, d):
    return P.random_split(B.anchors(spark, d).drop("split"), "study_id", 1).select("study_id", "split")


@query("SELECT a.study_id, CASE WHEN place * 100 <= n * 10 THEN 'valid' ELSE a.split END AS split FROM anchors a LEFT JOIN " + _ranks(1, "study_id", "anchors WHERE split = 'train'") + " USING (study_id)", B.ANCHORS)
def holdout(spark, d):
    return P.holdout(B.anchors(spark, d), "study_id", 10, 1).select("study_id", "split")


@query("SELECT o_orderkey, 1.0 / count(*) OVER (PARTITION BY o_orderstatus) AS weight FROM orders")
def balanced_weights(spark, d):
    return P.balanced_weights(B.read(spark, d, "orders"), "o_orderstatus").select("o_orderkey", "weight")


_POISSON = "m AS (SELECT o_orderstatus AS s, 500.0 / count(*) AS m FROM orders GROUP BY 1), cdf AS (SELECT s, k.k AS k, sum(exp(-m + i.i * ln(m) - lgamma(i.i + 1))) AS c FROM m, range(0, 3000) k(k), range(0, 60) i(i) WHERE i.i <= k.k AND k.k < greatest(20, ceil(4 * m)) AND k.k < 60 GROUP BY 1, 2)"


@query(f"SELECT o_orderkey, o_orderstatus, CAST(k + 1 AS INT) AS copy FROM (SELECT o_orderkey, o_orderstatus, ({_h(1, 'o_orderkey')} % 1073741824 + 0.5) / 1073741824 AS u FROM orders) JOIN cdf ON s = o_orderstatus AND c < u", _POISSON)
def balanced_sample(spark, d):
    return P.balanced_sample(B.read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 500, 1).select("o_orderkey", "o_orderstatus", "copy")


def _cohort(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("study_id"), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("label"))
    return B.anchors(spark, d).join(o, "study_id").withColumnRenamed("anchor_time", "study_time").withColumn("impression_id", F.col("study_id").cast("string"))


_CHECKED = f"{B.ANCHORS}, r AS (SELECT study_id, person_id, anchor_date, split, o_orderstatus = 'F' AS y FROM anchors JOIN orders ON o_orderkey = study_id), m AS (SELECT count(*) - count(person_id) AS np, count(*) - count(anchor_date) AS nt, count(*) - count(y) AS ny, count(*) - count(split) AS ns, count(*) - count(study_id) AS ni, avg(y::INT) AS p, count(*) FILTER (WHERE split NOT IN ('train', 'valid', 'test')) AS os, count(*) - count(DISTINCT study_id) AS dup, count(*) FILTER (WHERE anchor_date < DATE '1980-01-01') AS early, count(*) FILTER (WHERE anchor_date > DATE '2025-01-01') AS late FROM r), x AS (SELECT count(*) AS crossing FROM (SELECT 1 FROM r GROUP BY person_id HAVING count(DISTINCT split) > 1)), z AS (SELECT count(*) AS across FROM (SELECT 1 FROM r GROUP BY study_id HAVING count(*) > 1 AND count(DISTINCT split) > 1))"


@query("SELECT 'column ' || unnest(['person_id', 'study_time', 'label', 'split', 'impression_id']) || ' present' AS check_, 'PASS' AS status UNION ALL SELECT c, CASE WHEN ok THEN 'PASS' WHEN c LIKE 'no times%' THEN 'WARN' ELSE 'FAIL' END FROM m, x, z, LATERAL (VALUES ('no nulls in person_id', np = 0), ('no nulls in study_time', nt = 0), ('no nulls in label', ny = 0), ('no nulls in split', ns = 0), ('no nulls in impression_id', ni = 0), ('labels are true or false', TRUE), ('prevalence in range', p BETWEEN 0.05 AND 0.30), ('splits are train, valid or test', os = 0), ('no patient in several splits', crossing = 0), ('no duplicate impression ids', dup = 0), ('no duplicate across splits', across = 0), ('no times before the first day', early = 0), ('no times after the last day', late = 0), ('patients with several studies', TRUE)) AS t(c, ok)", _CHECKED)
def cohort_checks(spark, d):
    return Q.cohort_checks(_cohort(spark, d)).select(F.col("check").alias("check_"), "status")


@query("SELECT 'column ' || unnest(['patient_id', 'time', 'label']) || ' present' AS check_, 'PASS' AS status UNION ALL SELECT 'no duplicate patient and time' AS check_, CASE WHEN count(*) = count(DISTINCT (o_custkey, o_orderdate)) THEN 'PASS' ELSE 'FAIL' END AS status FROM orders UNION ALL SELECT 'prevalence as expected', CASE WHEN abs(avg(CAST(o_orderstatus = 'F' AS INT)) - 0.33) <= 0.02 THEN 'PASS' ELSE 'FAIL' END FROM orders")
def label_checks(spark, d):
    df = _cohort(spark, d).select(F.col("person_id").alias("patient_id"), F.col("study_time").alias("time"), (F.col("label") == "True").cast("int").alias("label"))
    return Q.label_checks(df, 0.33).select(F.col("check").alias("check_"), "status")


_CHECK = "CASE WHEN n = 0 THEN 'PASS' ELSE bad END AS status, CAST(n AS VARCHAR) AS detail"


@query(f"SELECT \"check\", {_CHECK} FROM (SELECT 'values are finite' AS \"check\", 'FAIL' AS bad, count(*) FILTER (WHERE isnan(l_quantity) OR isinf(l_quantity)) AS n FROM lineitem UNION ALL SELECT 'rows belong to the cohort', 'FAIL', count(*) FILTER (WHERE o_orderkey IS NULL) FROM keys UNION ALL SELECT 'studies have features', 'WARN', count(*) FILTER (WHERE l_orderkey IS NULL) FROM keys UNION ALL SELECT 'splits are known', 'FAIL', count(*) FILTER (WHERE coalesce(split, '') NOT IN ('train', 'valid', 'test')) FROM anchors UNION ALL SELECT 'no patient in several splits', 'FAIL', count(*) FROM (SELECT person_id FROM anchors GROUP BY 1 HAVING count(DISTINCT split) > 1))", f"{B.ANCHORS}, keys AS (SELECT * FROM (SELECT DISTINCT l_orderkey FROM lineitem) FULL JOIN orders ON l_orderkey = o_orderkey)")
def matrix_checks(spark, d):
    long = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("study_id"), F.col("l_quantity").alias("value"))
    return Q.matrix_checks(long, B.anchors(spark, d))


@query("SELECT \"check\", CASE WHEN holds THEN 'PASS' ELSE bad END AS status, detail FROM (SELECT 'key types agree' AS \"check\", TRUE AS holds, 'FAIL' AS bad, '' AS detail UNION ALL SELECT 'all images matched', avg(CAST(vec_id % 5 <> 0 AS DOUBLE)) = 1, 'WARN', CAST(round(avg(CAST(vec_id % 5 <> 0 AS DOUBLE)), 4) AS VARCHAR) FROM embeddings UNION ALL SELECT 'no missing splits', count(*) FILTER (WHERE vec_id % 5 = 0) = 0, 'FAIL', CAST(count(*) FILTER (WHERE vec_id % 5 = 0) AS VARCHAR) FROM embeddings UNION ALL SELECT 'no patient in several splits', TRUE, 'FAIL', '0' UNION ALL SELECT 'both classes in every split', count(*) FILTER (WHERE k < 2) = 0, 'WARN', CAST(count(*) FILTER (WHERE k < 2) AS VARCHAR) FROM (SELECT vec_id % 3 = 0 AS s, count(DISTINCT vec_id % 2) AS k FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1))")
def split_replay(spark, d):
    e = B.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("scan"), "vec_id")
    mapping = e.where("vec_id % 5 <> 0").select("scan", F.col("vec_id").alias("study_id"), F.col("vec_id").alias("person_id"))
    labels = e.select(F.col("vec_id").alias("study_id"), (F.col("vec_id") % 2).alias("label"))
    splits = e.select(F.col("vec_id").alias("study_id"), F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return Q.split_replay(e.select("scan"), mapping, labels, splits)


@query("SELECT split, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS prevalence FROM orders JOIN anchors ON study_id = o_orderkey GROUP BY 1", B.ANCHORS)
def split_prevalence(spark, d):
    return rounded(Q.split_prevalence(_cohort(spark, d).withColumn("label", (F.col("label") == "True").cast("int"))), "prevalence")


@query("SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders) a JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders) b ON a.o_custkey = b.o_custkey AND a.s < b.s GROUP BY 1, 2")
def split_overlap(spark, d):
    return Q.split_overlap(B.read(spark, d, "orders").withColumn("split", F.col("o_orderpriority")), "o_custkey")


@query("SELECT o_custkey AS split, count(DISTINCT o_orderstatus) AS classes FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) < 2")
def single_class_splits(spark, d):
    return Q.single_class_splits(B.read(spark, d, "orders").select(F.col("o_custkey").alias("split"), F.col("o_orderstatus").alias("label")))


@query("SELECT study_id FROM anchors WHERE split = 'test'", B.ANCHORS)
def require_split(spark, d):
    return Q.require_split(B.anchors(spark, d), "test").select("study_id")


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)) AS o_orderkey_repeated, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1)) AS o_custkey_repeated")
def one_to_one(spark, d):
    return Q.one_to_one(B.read(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("SELECT count(*) AS attempts, count(*) FILTER (WHERE l_quantity < 3) AS failures, count(*) FILTER (WHERE l_quantity < 3) / CAST(count(*) AS DOUBLE) AS rate FROM lineitem")
def failure_rate(spark, d):
    return Q.failure_rate(B.read(spark, d, "lineitem"), F.col("l_quantity") < 3)


# Sources and sinks: written to a folder the session shares, and read again.


def _folder(spark) -> str:
    return f"{io.shared_folder(spark)}/sinks-{spark.sql('SELECT uuid()').first()[0]}"


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def keep_positive(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", " true ").when(F.col("o_orderstatus") == "O", "No").otherwise("CENSORED")
    return K.keep_positive(B.read(spark, d, "orders").withColumn("label", label)).select("o_orderkey", "o_custkey")


def _name(spark) -> str:
    return "t_" + spark.sql("SELECT replace(uuid(), '-', '')").first()[0]


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def save_table(spark, d):
    name = _name(spark)
    io.save_table(B.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), name)
    return spark.table(name)


@query("SELECT p_partkey, p_name, p_size FROM part")
def create_table_from_csv(spark, d):
    path = f"{_folder(spark)}/part"
    B.read(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    return io.create_table_from_csv(spark, path, _name(spark)).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("long").alias("p_size"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def read_delimited(spark, d):
    path = f"{_folder(spark)}/t.tsv"
    B.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).write.option("header", True).option("sep", "\t").csv(path)
    return io.read_delimited(spark, path, "id string, status string, price double").select(F.col("id").cast("long").alias("id"), "status", "price")


@query("SELECT o_orderkey AS id, attempts, failures, failures / CAST(attempts AS DOUBLE) AS rate FROM orders, (SELECT count(*) AS attempts, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS failures FROM orders) WHERE o_orderkey % 10 <> 0")
def read_tolerant(spark, d):
    path = f"{_folder(spark)}/t.csv"
    B.read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise(F.col("o_orderkey").cast("string")).alias("id")).write.option("header", True).csv(path)
    kept, report = io.read_tolerant(spark, path, "id long")
    return kept.select("id").crossJoin(F.broadcast(report))  # one row


@query("SELECT person_id, concept_id AS measurement_concept_id, value AS value_as_number FROM measurement WHERE concept_id IN (3, 7, 11)", B.MEASUREMENT)
def read_measurements(spark, d):
    path = _folder(spark)
    m = B.measurements(spark, d).select("person_id", F.col("concept_id").alias("measurement_concept_id"), F.to_date("event_time").alias("measurement_date"), F.col("event_time").cast("timestamp").alias("measurement_datetime"), F.col("value").alias("value_as_number"))
    m.write.parquet(f"{path}/measurement")
    return io.read_measurements(io.read_omop(spark, path, "measurement"), [3, 7, 11]).select("person_id", "measurement_concept_id", "value_as_number")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def cached_result(spark, d):
    build = lambda: B.read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    folder = _folder(spark)
    io.cached(spark, folder, {"status": "F"}, build)
    return io.cached(spark, folder, {"status": "F"}, lambda: 1 / 0)


@query("SELECT study_id, feature, value, 1 AS observed FROM (SELECT study_id, code AS feature, max(value) AS value FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY 1, 2)", B.MET)
def export_matrix(spark, d):
    long = _codes(spark, d)
    folder = _folder(spark)
    io.export_matrix(long, B.anchors(spark, d), {"window": 30}, folder, drop_all_missing=True)
    return spark.read.parquet(f"{folder}/X").join(spark.read.parquet(f"{folder}/mask"), ["study_id", "feature"]).withColumn("observed", F.col("observed").cast("int"))


def _codes(spark, d):
    from ..operators.windows import window_join

    return window_join(B.measurements(spark, d), B.anchors(spark, d), 30).groupBy("study_id", F.col("code").alias("feature")).agg(F.max("value").alias("value"))


@query("SELECT study_id, code AS feature, max(value) AS value FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY 1, 2 HAVING max(value) <> 0", B.MET)
def export_long(spark, d):
    path = _folder(spark)
    io.export_long(_codes(spark, d), path)
    return io.read_delimited(spark, path, "study_id long, feature string, value double")


@query("SELECT study_id, concept_id, value, CAST(days_before AS BIGINT) AS days_before FROM met WHERE days_before BETWEEN 1 AND 7 AND concept_id <> 0", B.MET)
def export_timeline(spark, d):
    path = _folder(spark)
    io.export_timeline(_timeline(spark, d), path)
    return spark.read.parquet(path).select("study_id", "concept_id", "value", F.col("days_before").cast("long").alias("days_before"))


def _timeline(spark, d):
    from ..operators.concepts import timeline

    rows = timeline({"labs": B.measured(spark, d)}, B.anchors(spark, d), {"labs": 7})
    return B.known(rows, spark, d).select(rows.columns)


@query("SELECT study_id, concept_id, value FROM met WHERE days_before BETWEEN 1 AND 7 AND concept_id <> 0", B.MET)
def write_events(spark, d):
    path = _folder(spark)
    io.write_events(_timeline(spark, d).select("study_id", "concept_id", "value"), path)
    back = io.read_delimited(spark, f"{path}/csv", "study_id long, concept_id long, value double")
    return back.intersectAll(spark.read.parquet(f"{path}/parquet"))


@query("SELECT study_id, concept_id, value FROM met WHERE days_before BETWEEN 1 AND 7 AND concept_id <> 0 ORDER BY study_id, event_time, concept_id, value LIMIT 100", B.MET)
def timeline_preview(spark, d):
    from ..operators.concepts import timeline_preview as f

    return f(_timeline(spark, d), 100).select("study_id", "concept_id", "value")


@query("SELECT split, count(*) AS n FROM anchors GROUP BY 1", B.ANCHORS)
def write_by_split(spark, d):
    path = _folder(spark)
    io.write_by_split(B.anchors(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT patient_id, label, round(prob, 6) AS prob FROM preds WHERE model = 'A' AND task = 'toxic' AND patient_id % 2 = 0", B.PREDICTIONS)
def predictions_sink(spark, d):
    path = _folder(spark)
    p = B.predictions(spark, d).withColumn("time", F.lit("2020-01-01").cast("timestamp"))
    io.write_predictions(p, path)
    splits = p.select("patient_id", F.when(F.col("patient_id") % 2 == 0, "test").otherwise("train").alias("split")).distinct()
    return rounded(io.load_predictions(spark, path, "A", "toxic", splits, "test").select("patient_id", "label", "prob"), "prob")


@query("SELECT o_orderkey, o_custkey AS patient_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def split_prediction_id(spark, d):
    key = F.concat_ws("_", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    df = io.split_prediction_id(B.read(spark, d, "orders").select("o_orderkey", key.alias("id")), "id")
    return df.select("o_orderkey", "patient_id", F.to_date("time").cast("string").alias("day"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def rewrite_dataset(spark, d):
    path = _folder(spark)
    io.rewrite(spark, f"{d}/orders.parquet", path)
    return io.read_table(spark, path).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS rows, 'nope' AS missing, FALSE AS unnamed, FALSE AS ok FROM orders")
def validate_source(spark, d):
    return io.validate_source(B.read(spark, d, "orders"), ["o_orderkey", "nope"])


@query("SELECT study_id, count(feature) AS observed, count(CASE WHEN value <> 0 THEN 1 END) AS filled, coalesce(sum(value), 0) AS total FROM anchors LEFT JOIN (SELECT study_id, code AS feature, max(value) AS value FROM met WHERE days_before BETWEEN 1 AND 30 GROUP BY 1, 2) USING (study_id) GROUP BY 1", B.MET)
def fuse_sparse(spark, d):
    rows, layout = io.fuse_sparse(_codes(spark, d), B.anchors(spark, d).select("study_id", F.lit(1).alias("label")))
    n = F.coalesce(F.col("size") / 2, F.lit(0))
    seen = F.coalesce(F.size(F.filter("indices", lambda i: i >= n)), F.lit(0))
    total = F.coalesce(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    return rows.select("study_id", F.greatest(seen, F.lit(0)).cast("long").alias("observed"), F.greatest(F.size("indices") - seen, F.lit(0)).cast("long").alias("filled"), (total - F.greatest(seen, F.lit(0))).alias("total"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id AS id, label, embedding AS vector, (SELECT count(*) FROM embeddings WHERE vec_id % 9 = 0) AS repeated_ids FROM embeddings")
def vector_index(spark, d):
    from ..operators.series import vector_index as f

    e = B.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    rows, twice = f(e.unionByName(e.where("id % 9 = 0")))
    return rows.select("row", "id", "label", "vector", F.lit(twice).alias("repeated_ids"))
