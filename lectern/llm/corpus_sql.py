"""DuckDB SQL for the queries on mixing, hard negatives and divergence."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n FROM d GROUP BY source
), w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS HUGEINT) AS w FROM s
), r AS (
  SELECT *, (SELECT sum(n) FROM s) AS total, coalesce(sum(2 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w
), l AS (
  SELECT CAST(3 * total - 2 * capped AS HUGEINT) AS num, CAST(2 * open AS HUGEINT) AS den FROM r WHERE (3 * total - 2 * capped) * w <= 4 * n * open ORDER BY n / w, source LIMIT 1
), t AS (
  SELECT source, n, CASE WHEN 2 * n * den <= w * num THEN CAST(2 * n AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target, CASE WHEN 2 * n * den <= w * num THEN 2 * n ELSE (w * num) // den END AS budget FROM w, l
), a AS (
  SELECT d.doc_id, d.size, CAST(t.n AS BIGINT) AS source_size, t.target, CASE WHEN budget >= t.n THEN 1 ELSE 0 END AS base, budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(base * size + greatest(0, least(size, budget - base * source_size - ahead)) AS BIGINT) AS taken FROM a
"""

HARD_NEGATIVES = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), o AS (
  SELECT n, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d)
), kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM o GROUP BY 1, 2 HAVING count(DISTINCT n) >= 30
), langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS total FROM kept GROUP BY 1
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT o.lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sizes AS (SELECT lang, source, coalesce(sum(c), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY 1, 2
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(n.c, 0) AS c, 1 + (1000000000 * (coalesce(n.c, 0) + 5)) // (s.total + 5 * l.v) AS p, 1 + (1000000000 * (k.c + 5)) // (l.total + 5 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts n ON n.lang = s.lang AND n.source = s.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
  GROUP BY 1, 2, 3
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked QUALIFY part = 'pair' OR rank <= 50
"""
