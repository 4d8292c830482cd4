"""DuckDB's SQL for the queries that it can express, over the same tables."""

from __future__ import annotations

from surfaceloom.llm import secrets, sharding, spans, substrings

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, v.x) DESC, v.vec_id) AS rank
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
) WHERE rank <= 10
"""

#: A component's smallest id, by walking the links from each row.
_REACH = """
reach(a, b) AS (
  SELECT {id}, {id} FROM {rows} UNION SELECT reach.a, l.b FROM reach JOIN links AS l ON l.a = reach.b
), smallest AS (SELECT a AS {id}, min(b) AS component_id FROM reach GROUP BY a)
"""

NEAR = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p, v AS q WHERE p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9
), {_REACH.format(id="vec_id", rows="v")}, counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM smallest LEFT JOIN counted USING (vec_id)
"""

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets
), links AS MATERIALIZED (
  SELECT p.doc_id AS a, q.doc_id AS b FROM shingles AS p JOIN shingles AS q ON p.h = q.h AND p.doc_id <> q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), {_REACH.format(id="doc_id", rows="sets")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN smallest USING (doc_id)
"""

ORACLES = {
    "op2_exact_topk": TOPK,
    "op4_secret_scans": secrets.ORACLE,
    "op5_jaccard_join": JACCARD,
    "op6_embedding_neardup": NEAR,
    "op7_extendible_sharding": sharding.ORACLE,
    "op8_sentence_spans": spans.ORACLE,
    "op9_suffix_dedup": substrings.ORACLE,
}
