"""DuckDB SQL for the near-duplicate queries."""

NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), pairs AS (
  SELECT x, y FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE c >= 0.8 * (sx.n + sy.n - c)
), links AS (SELECT x AS u, y AS v FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM words
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), classes AS (SELECT u AS doc_id, min(v) AS class_id FROM reach GROUP BY u
), degrees AS (SELECT u AS doc_id, count(*) AS n_links FROM links GROUP BY u)
SELECT w.doc_id, c.class_id, coalesce(d.n_links, 0) AS n_links, coalesce(s.n, 0) AS n_shingles, c.class_id = w.doc_id AS kept, 1 AS n_rows
FROM words w JOIN classes c USING (doc_id) LEFT JOIN degrees d USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

EMBEDDING_LINKS = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), good AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM vectors WHERE ok AND label IS NOT NULL
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM vectors
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), classes AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u
), degrees AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT c.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM classes c LEFT JOIN degrees d USING (vec_id)
"""
