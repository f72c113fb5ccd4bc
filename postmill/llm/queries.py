"""One query per operator of this subpackage, with its production parameters, and SQL where it can say the same."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import chat_format, decontaminate, hamming, hard_negatives, html_text, mixing, odd_sketch, ptolemy, quality
from postmill.llm import sharding, simhash, token_counts, warc
from postmill.llm.common import read_table
from postmill.sources.scratch import scratch_path

CONTEXT = 512
SHARDS = 24
NEIGHBOURS = 10
CLUSTERS, CLUSTER_ROUNDS, DIMENSIONS = 40, 5, 64
#: Target weights of the mixture; every source that is not named has the weight of ``*``.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2, "src5": 2, "*": 1}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")
    counts = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    found = hamming.search_vectors(vectors, F.col("vec_id") % 100 == 0, NEIGHBOURS)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance"))


OP3_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
), pairs AS (
  SELECT q.vec_id AS query_id, q.code AS query_code, c.vec_id AS neighbour_id, hamming(q.code, c.code) AS distance
  FROM codes q, codes c WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_code ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    chats = chat_format.format_chat(chat_format.canonical_turns(rows.unionByName(fixed)))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("segments"))
    return (
        chats.select("conv_id", chat_format.read_back(F.col("formatted")).alias("_read"), loss.alias("_loss"), F.length("formatted").alias("_chars"))
        .select(
            "conv_id",
            F.size("_read").cast("long").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.col("_chars").cast("long").alias("formatted_chars"),
        )
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': </turn>' || chr(10)) + body)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_code(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, md5(coalesce(text, '')) AS key, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS l, unnest(range(1, (len(w) - least(len(w), 13) + 2)::BIGINT)) AS i FROM item WHERE len(w) > 0)
), text AS (SELECT DISTINCT key, w FROM doc),
occ AS (
  SELECT key, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT key, w, l, unnest(range(1, (len(w) - l + 2)::BIGINT)) AS i FROM text, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
), hit AS (SELECT occ.key, occ.i, occ.l, win.item FROM occ JOIN win ON occ.win = win.win AND occ.l = win.l),
words_hit AS (SELECT key, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT key, unnest(range(i, i + l)) AS p FROM hit) GROUP BY key),
items AS (SELECT key, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT key, item FROM hit) GROUP BY key)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words_hit USING (key) LEFT JOIN items USING (key)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return warc.read_records(warc.write_archives(read_table(spark, sf_dir, "pages"), folder), folder)


OP8_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM payloads),
held AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS holder FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM held
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = quality.fit_classifier(documents, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(documents.select("doc_id", "text"), model)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def op11_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ptolemy.cluster_vectors(read_table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


def _op11_sql() -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for turn in range(CLUSTER_ROUNDS + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
  SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT v.row, c.cluster, {distance} AS distance FROM v, c{turn} c) GROUP BY row
)""")
        if turn < CLUSTER_ROUNDS:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{turn} c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS x FROM (
      SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
      FROM (SELECT cluster, unnest(v.x)::HUGEINT AS x, unnest(range({DIMENSIONS})) AS i FROM v JOIN a{turn} USING (row)) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    last = f"a{CLUSTER_ROUNDS}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1)::INTEGER AS cluster, x FROM v QUALIFY cluster < {CLUSTERS}
), {", ".join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN {last} USING (row) JOIN c{CLUSTER_ROUNDS} c USING (cluster)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), w AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id, label, x) AS row FROM v),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, a.row AS anchor_row, c.id, c.row, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.x, c.x), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM w a, w c WHERE a.id % 50 = 0 AND a.row <> c.row
), p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, id, row) AS place FROM s WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_row, p.row ORDER BY n.score DESC, n.id, n.row))::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_row = p.anchor_row AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = odd_sketch.near_duplicates(read_table(spark, sf_dir, "documents"), similarity=(85, 100))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP13_SQL = r"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, (len(w) - 3)::BIGINT), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM doc
), classes AS MATERIALIZED (
  SELECT min(row) AS class, min(doc_id) AS lowest, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (SELECT class, n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class < b.class
  GROUP BY a.class, a.n, b.class, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT class AS a, class AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
named AS (SELECT reach.a AS class, min(lowest) AS component_id FROM reach JOIN classes ON reach.b = classes.class GROUP BY reach.a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id, sets.doc_id IS NOT DISTINCT FROM coalesce(component_id, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN named ON classes.class = named.class
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_chat_format": op4_chat_format,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_ptolemaic_clusters": op11_ptolemaic_clusters,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_odd_sketch": op13_odd_sketch,
}

ORACLES = {
    "op3_hamming_topk": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_ptolemaic_clusters": _op11_sql(),
    "op12_hard_negatives": OP12_SQL,
    "op13_odd_sketch": OP13_SQL,
}
