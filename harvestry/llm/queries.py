"""The registered queries of this folder: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.session import work_folder
from harvestry.llm import centroids, decontaminate, jaccard, langid, neighbours, packing, quality, sharding, slack, substrings, toolcalls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).select("doc_id", "score", "kept")


def op5_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).withColumnRenamed("id", "page_id").drop("intact")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_groups(docs).withColumnRenamed("id", "doc_id")


#: The user's turns as calls of one tool: the prompt must say something and not be over-long.
REPLY_SCHEMA = {
    "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}},
}


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn calls the tool ``reply`` and waits for the reply before; an assistant turn is the result of the turn before it."""
    said = _table(spark, sf_dir, "conversations")

    def name(turn: str) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.expr(turn))

    calls = said.filter("role = 'user'").select(
        "conv_id", "turn", name("turn").alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"), name("turn - 2").alias("after"))
    results = said.filter("role = 'assistant'").select("conv_id", "turn", name("turn - 1").alias("call_id"), F.col("text").alias("content"))
    messages = said.filter("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return toolcalls.link_tool_calls(messages, calls, results, {"reply": REPLY_SCHEMA})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).withColumnRenamed("id", "doc_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long")).withColumnRenamed("id", "vec_id")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(listed, 256).alias("centroid_sha256"))


def op13_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return slack.pack_windows(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_embedding_neighbours": op5_embedding_neighbours,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_tool_calls": op8_tool_calls,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_slack_packing": op13_slack_packing,
}

#: Words of every text, unchanged, with their place from 0.
_WORDS = r"""words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

#: Distinct 5-word shingles of the texts, lower-cased in A-Z; a shorter text is one.
_SHINGLES = r"""shingled AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM shingled)"""

#: Round r assigns by the centroids c{r} (a{r}: nearest by distance and number); c{r + 1} are floors of exact means.
_ROUNDS = ",\n".join(
    f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min_by(c, d * 64 + c) AS cluster, min(d) AS distance
  FROM (SELECT vec_id, c, sum((v - m) * (v - m)) AS d FROM vals JOIN c{r} USING (j) GROUP BY vec_id, c) GROUP BY vec_id)"""
    + (f""",
c{r + 1} AS MATERIALIZED (
  SELECT c, j, CASE WHEN n IS NULL THEN m ELSE (t - ((t % n) + n) % n) // n END AS m
  FROM c{r} LEFT JOIN (SELECT cluster AS c, j, sum(v) AS t, count(*) AS n FROM a{r} JOIN vals USING (vec_id) GROUP BY ALL) USING (c, j))""" if r < 5 else "")
    for r in range(6))

ORACLE: dict[str, str] = {
    "op3_substring_dedup": f"""
WITH {_WORDS},
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM words WHERE len(w) >= 13),
wins AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS d FROM wins GROUP BY s),
hit AS (SELECT wins.doc_id, wins.p FROM wins JOIN firsts USING (s) WHERE wins.doc_id > firsts.d),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM hit),
lists AS (SELECT doc_id, list(q) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
  FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE {_SHINGLES},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least_of AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)""",
    "op9_decontamination": f"""
WITH {_SHINGLES},
classes AS (SELECT text, min(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY text),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM classes),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM item_words),
item_sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM shingles JOIN item_shingles USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN item_sizes USING (item_id) WHERE 4 * n_shared >= 3 * n_item""",
    # the checksum goes byte by byte through the table of the polynomial
    "op10_sharding": """
WITH tab AS (
  SELECT list(t ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS t FROM range(256) r(i))),
raw AS (
  SELECT doc_id, md5(coalesce(text, '')) AS m, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM documents),
summed AS (
  SELECT doc_id, ('0x' || m[1:15])::BIGINT AS key, size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda a, x: xor(tab[(xor(a, x) % 256)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM raw, tab),
placed AS (
  SELECT *, sum(size) OVER o - size AS first, row_number() OVER o - 1 AS rank, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY key) AS held
  FROM summed WINDOW o AS (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, CASE WHEN held * 480 > total THEN first ELSE min(first) OVER (PARTITION BY key) END AS place FROM placed),
sharded AS (SELECT *, least(23, (place * 24) // total)::INTEGER AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sharded""",
    "op5_embedding_neighbours": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.93),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least_of AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN least_of USING (vec_id)""",
    "op6_warc_revisits": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY t)
SELECT page_id, n AS payload_bytes, sha256(p.t) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.t = p.t""",
    "op12_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda c: c IS NOT NULL AND isfinite(c))) = 64),
vals AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS j, unnest(x) AS m FROM (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40))),
{_ROUNDS},
inertias AS (SELECT cluster, sum(distance) AS cluster_inertia FROM a5 GROUP BY cluster),
texts AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, cluster_inertia::BIGINT AS cluster_inertia,
       (SELECT sum(distance) FROM a5)::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN inertias USING (cluster) JOIN texts ON c = cluster""",
    "op8_tool_calls": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
u AS (SELECT *, 'call-' || conv_id || '-' || turn AS call_id FROM t WHERE role = 'user'),
isle AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g FROM u),
c AS (
  SELECT isle.*, row_number() OVER (PARTITION BY isle.conv_id, isle.turn % 2, g ORDER BY isle.turn) - 1 AS depth, a.turn IS NOT NULL AS answered,
         CASE WHEN length(isle.text) > 400 THEN '$.prompt: length out of range' WHEN length(isle.text) < 1 THEN '$.prompt: length out of range' END AS error
  FROM isle LEFT JOIN t a ON a.conv_id = isle.conv_id AND a.turn = isle.turn + 1 AND a.role = 'assistant')
SELECT conv_id, turn, 'call' AS kind, call_id, turn AS order_turn, depth, 1::INTEGER AS step,
       CASE WHEN NOT answered THEN 'unanswered' WHEN error IS NOT NULL THEN 'invalid' ELSE 'ok' END AS status, error,
       json_object('role', 'assistant', 'tool_calls', [json_object('function', json_object('arguments', json_object('prompt', text, 'turn', turn)::VARCHAR, 'name', 'reply'), 'id', call_id, 'type', 'function')])::VARCHAR AS json
FROM c
UNION ALL
SELECT t.conv_id, t.turn, 'result', 'call-' || t.conv_id || '-' || (t.turn - 1), t.turn, coalesce(c.depth, 0), 2::INTEGER, CASE WHEN c.depth IS NULL THEN 'orphan' ELSE 'ok' END, NULL,
       json_object('content', t.text, 'role', 'tool', 'tool_call_id', 'call-' || t.conv_id || '-' || (t.turn - 1))::VARCHAR
FROM t LEFT JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1 WHERE t.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, turn, -1, 0::INTEGER, 'ok', NULL, json_object('content', text, 'role', role)::VARCHAR
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')""",
}
