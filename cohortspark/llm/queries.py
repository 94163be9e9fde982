"""Queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, hard_negatives, jaccard_join, langid, mixing, packing, repair, secret_scan, sharding, topk, toxicity, warc
from .common import read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    added = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    conversations = read(spark, sf_dir, "conversations").select(*columns).unionByName(added)
    back = chat.read_back(chat.expand_prefix_targets(conversations))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def fold(n: int, c: str = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text, modulo n; null ids are in none, so they are neither held out nor
    learned from."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(3) != 1))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role by a hash of their conversation and turn; nulls are a space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(chance == 1, "").when(chance == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(chance == 4, "user").otherwise(said("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    counts, repaired = repair.repair(damaged(conversations))
    same = repair.same_key("conv_id")
    found = counts.select(same, *(c for c in counts.columns if c != "conv_id"))
    digests = repair.digested(repaired).select(same, "repaired_sha256")
    every = conversations.select("conv_id").distinct().select("conv_id", same)
    joined = every.join(found, "same", "left").join(digests, "same", "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 50 = 0"), label=label)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secret_scan.BASE]
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    digest = F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256)
    return scanned.select("doc_id", *map(of, base), digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_nearest": op3_nearest,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_top_inner_products": op7_top_inner_products,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_repair": op11_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secrets": op13_secrets,
}

def secret_sql() -> str:
    """op13 in SQL: a kind's matches and the pieces of text between them, whose lengths make the starts."""
    # kind, pattern, how much of a match is no body, least length of the body
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 6),
        ("access", "AKIA[A-Z0-9]+", "", 20),
        ("hex", "[0-9a-f]{24,}", "", 24),
        ("forge", "gh[opsur]_[A-Za-z0-9]+", "", 40),
        ("chat", "xox[abprs]-[A-Za-z0-9-]+", "", 24),
        ("cloud", "AIza[A-Za-z0-9_-]+", "", 39),
        ("web", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "", 40),
        ("key", r"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----", "", 20),
    ]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for n, (kind, pattern, head, least) in enumerate(kinds):
        body = f"length(m[i]) - length(regexp_extract(m[i], {quoted(head)}))" if head else "length(m[i])"
        parts.append(
            f"SELECT row, {n} AS n, '{kind}' AS kind, s.a AS a, s.b AS b FROM (SELECT row, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), "
            f"'b': list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), 'n': {body}}}), lambda x: x.n >= {least})) AS s FROM (SELECT row, regexp_extract_all(text, {quoted(pattern)}) AS m, string_split_regex(text, {quoted(pattern)}) AS p FROM t))"
        )
    said = "CAST(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) AS VARCHAR)"
    return (
        "WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),\nspans AS ("
        + "\nUNION ALL ".join(parts)
        + f""")
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg({said}, ',' ORDER BY a, n) FILTER (n < 3), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY a, n) FILTER (n IS NOT NULL), '') AS spans FROM t LEFT JOIN spans USING (row) GROUP BY row"""
    )


#: SQL for the queries that it can express over whole tables. Hashes, models, archives, tokenizers and seeded choices are beyond
#: it; tests/llm holds those queries against brute force, round trips or held-out accuracy. op3 is approximate.
ORACLES: dict[str, str] = {
    "op6_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(0))) ELSE [array_to_string(w, chr(0))] END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)""",
    "op7_top_inner_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op8_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text) + (length(text) - length(replace(text, '\', ''))) + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS shown FROM t),
p AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto, role = 'assistant' OR lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS ends FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (WHERE ends) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id""",
    "op11_repair": r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
chance AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([CAST(ascii(k[i]) AS BIGINT)], list_value(-1, -1, -1, -1, -1, -1, -1, -1))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS c FROM given),
damaged AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM chance, range(2) AS r(copy) WHERE c <> 0 AND (copy = 0 OR c = 3)),
ordered AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, conv_id, turn, role, text, role[1:1] AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
r AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, CASE WHEN lead(1) OVER (PARTITION BY g ORDER BY i) IS NULL THEN 0 WHEN initial || lead(initial) OVER (PARTITION BY g ORDER BY i) IN ('su', 'ua', 'au') THEN 0 ELSE 1 END AS illegal FROM ordered),
moves(state, letter, initial, cost, result) AS (SELECT s, 'D', CAST(NULL AS VARCHAR), 3, s FROM range(4) AS x(s) UNION ALL SELECT s, 'R', CAST(NULL AS VARCHAR), 2, CASE s WHEN 2 THEN 3 ELSE 2 END FROM range(4) AS x(s) UNION ALL VALUES (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2)),
inserted(state, put, more, after) AS (SELECT s, '', 0, s FROM range(4) AS x(s) UNION ALL SELECT s, 'I', 2, CASE s WHEN 2 THEN 3 ELSE 2 END FROM range(4) AS x(s) UNION ALL SELECT s, 'II', 4, CASE s WHEN 2 THEN 2 ELSE 3 END FROM range(4) AS x(s)),
way(g, i, state, cost, audit) AS (
  SELECT g, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST('' AS VARCHAR) FROM r GROUP BY g
  UNION ALL
  SELECT g, i, CAST(result AS BIGINT), CAST(cost AS BIGINT), audit FROM (
    SELECT w.g, r.i, m.result, w.cost + p.more + m.cost + CASE WHEN m.letter <> 'D' AND r.fault = 't' THEN 1 ELSE 0 END AS cost, w.audit || p.put || m.letter AS audit
    FROM way w JOIN r ON r.g = w.g AND r.i = w.i + 1 JOIN inserted p ON p.state = w.state JOIN moves m ON m.state = p.after AND (m.initial IS NULL OR m.initial = r.initial) AND (m.letter = 'D' OR r.fault NOT IN ('b', 'd')))
  QUALIFY row_number() OVER (PARTITION BY g, result ORDER BY cost, audit) = 1),
ends AS (SELECT g, min(cost) AS cost, arg_min(audit, {'c': cost, 'a': audit}) AS audit FROM (SELECT w.g, w.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit FROM way w JOIN (SELECT g, max(i) AS n FROM r GROUP BY g) USING (g) WHERE w.i = n) GROUP BY g),
letters AS (SELECT g, j, audit[j] AS e, length(replace(audit[1:j], 'I', '')) AS i FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS j FROM ends)),
walked AS (SELECT l.*, r.role, r.text, CASE e WHEN 'K' THEN r.initial END AS kept, row_number() OVER (PARTITION BY l.g ORDER BY j) AS n FROM letters l LEFT JOIN r ON r.g = l.g AND r.i = l.i AND e <> 'I' WHERE e <> 'D'),
based AS (SELECT *, max(CASE WHEN kept = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS system FROM walked),
said AS (SELECT g, j, CASE e WHEN 'K' THEN role ELSE CASE WHEN (n - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END AS line FROM based),
hashes AS (SELECT g, sha256(string_agg(line, chr(10) ORDER BY j)) AS h FROM said GROUP BY g),
counts AS (SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, sum(illegal) AS illegal FROM r GROUP BY g)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ends USING (g) LEFT JOIN hashes USING (g)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, v.vec_id, q.label = v.label AS same, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op13_secrets": secret_sql(),
}
