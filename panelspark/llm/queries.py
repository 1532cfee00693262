"""One query per operator over its whole table, with oracle SQL where SQL can express the result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import quality
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network, _ = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, network).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.jaccard_join import link_documents
    return link_documents(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
                                          WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.warc import round_trip
    return round_trip(_table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to FROM f
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.decontaminate import find_leaks
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import toxicity
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.near_vectors import link_vectors
    return link_vectors(_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.x
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.packing import pack
    return pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.token_files import round_trip
    return round_trip(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, vocabulary=49408)


URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.url_filter import Rule, judge
    return judge(_table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.line_dedup import drop_repeated_lines
    out = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL AND l.doc_id <> o.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE o.key IS NULL OR l.doc_id = o.last_doc), '')) AS kept_sha256
FROM lines l LEFT JOIN often o USING (key) GROUP BY l.doc_id
"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.manifest import verify_tampered
    return verify_tampered(_table(spark, sf_dir, "documents"))


# crc32 byte by byte: xor, then eight shifts with the reflected polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
            lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
OP11_SQL = """
WITH RECURSIVE framed AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    CASE WHEN """ + _CRC + """ % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS first FROM framed),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS cnt FROM leaves),
nodes AS (
  SELECT 0 AS lvl, lang, idx, leaf AS digest, cnt FROM placed
  UNION ALL
  SELECT lvl + 1, lang, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 7) // 8 FROM nodes WHERE cnt > 1 GROUP BY lvl, lang, idx // 8, cnt),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS cnt FROM nodes WHERE cnt = 1),
tops AS (
  SELECT 0 AS lvl, idx, digest, cnt FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 7) // 8 FROM tops WHERE cnt > 1 GROUP BY lvl, idx // 8, cnt),
steps AS (
  SELECT p.lang, p.idx, n.lvl, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx < p.idx // (8 ** n.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx > p.idx // (8 ** n.lvl)::BIGINT), '') AS r
  FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.cnt > 1 AND n.idx // 8 = p.idx // (8 ** (n.lvl + 1))::BIGINT GROUP BY p.lang, p.idx, n.lvl),
top_steps AS (
  SELECT s.lang, n.lvl, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx < s.idx // (8 ** n.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (WHERE n.idx > s.idx // (8 ** n.lvl)::BIGINT), '') AS r
  FROM subroots s JOIN tops n ON n.cnt > 1 AND n.idx // 8 = s.idx // (8 ** (n.lvl + 1))::BIGINT GROUP BY s.lang, n.lvl),
way AS (SELECT lang, idx, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY lang, idx),
top_way AS (SELECT lang, list(l || '|' || r ORDER BY lvl) AS path FROM top_steps GROUP BY lang),
proofs AS (
  SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE cnt = 1) AS root, p.first, list_concat(coalesce(w.path, []), coalesce(t.path, [])) AS path
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM p.lang AND w.idx = p.idx
  LEFT JOIN top_way t ON t.lang IS NOT DISTINCT FROM p.lang),
folded AS (SELECT *, list_reduce(list_concat([first], path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.sentencepieces import round_trip
    return round_trip(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.hard_negatives import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


QUERIES = {f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_warc_round_trip, op4_decontamination, op5_toxicity, op6_near_vectors, op7_best_fit_packing, op8_token_files, op9_line_dedup, op10_url_filter, op11_merkle_manifest, op12_sentencepiece, op13_hard_negatives)}
ORACLE = {"op2_jaccard_join": OP2_SQL, "op6_near_vectors": OP6_SQL, "op3_warc_round_trip": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op13_hard_negatives": OP13_SQL}
