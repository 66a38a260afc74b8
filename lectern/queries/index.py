"""Queries of paging, chunking, vectors and incremental indexing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import containment, index, pages, semantic, vectors
from lectern.queries import query, table
from lectern.storage import shared_dir

_PAGES = """p AS (
  SELECT doc_id AS key, string_split(text, chr(10)) AS parts, doc_id % 7 AS known FROM documents
), s AS (
  SELECT key, parts, len(parts) AS n_pages, CASE WHEN len(parts) = 1 THEN 'no-separators' WHEN known = 3 AND len(parts) <> 3 THEN 'count-mismatch'
    WHEN len(list_filter(parts, lambda x: trim(regexp_replace(x, '\\s', '', 'g')) = '')) > 0 THEN 'empty-page' ELSE 'ok' END AS status FROM p
), r AS (
  SELECT key, n_pages, status, unnest(range(len(parts))) AS page, unnest(list_transform(range(len(parts)), lambda i: CAST(coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x) + 1)), 0) AS BIGINT))) AS start, unnest(list_transform(parts, lambda x: length(x) + 1)) AS len FROM s
)"""


def _paged(spark, sf_dir):
    """Documents with a line read as a page; every seventh claims three pages."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("key"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"), F.when(F.col("doc_id") % 7 == 3, 3).alias("pages"))


@query(
    f"""WITH {_PAGES} SELECT key, CAST(page AS INTEGER) AS page, CAST(start AS INTEGER) AS start, CAST(start + len - CASE WHEN page = n_pages - 1 THEN 1 ELSE 0 END AS INTEGER) AS "end", status,
  CASE WHEN page % 3 = 1 THEN 'p' || CAST(page AS VARCHAR) WHEN page % 3 = 2 THEN CAST(page + 1 AS VARCHAR) ELSE CAST(page + 1 AS VARCHAR) END AS label FROM r"""
)
def page_boundaries(spark, sf_dir):
    t = pages.page_table(_paged(spark, sf_dir))
    labels = F.transform(F.sequence(F.lit(0), F.col("n_pages") - 1), lambda i: F.when(i % 3 == 1, F.concat(F.lit("p"), i.cast("string"))).when(i % 3 == 2, " "))
    return t.select("key", "page", "start", "end", "status", pages.page_label(F.col("page"), labels, F.col("n_pages")).alias("label"))


@query(f"WITH {_PAGES} SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 4) AS share FROM s GROUP BY 1")
def alignment_summary(spark, sf_dir):
    t = pages.page_table(_paged(spark, sf_dir)).where("page = 0")
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(t.agg(F.count(F.lit(1)).alias("total"))).select("status", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query(
    """WITH t AS (SELECT doc_id AS key, length(text) AS n, doc_id % 20 AS pages, length(text) // 3 AS pos FROM documents)
SELECT key, CASE WHEN pages > 0 AND n > 0 THEN least(pages, CAST(floor(pos / (n / pages)) AS BIGINT) + 1) END AS estimated, len(list_filter([0, 100, 500, 2500], lambda b: b <= pos)) - 1 AS page FROM t"""
)
def page_positions(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("n"), (F.col("doc_id") % 20).alias("pages"))
    pos = F.floor(F.col("n") / 3)
    bounds = F.array(*[F.lit(x) for x in (0, 100, 500, 2500)])
    return t.select("key", pages.estimated_page(pos, F.col("n"), F.col("pages")).cast("long").alias("estimated"), pages.page_of(bounds, pos).cast("long").alias("page"))


@query(
    r"""SELECT doc_id AS key, CAST(count(*) AS BIGINT) AS n_paragraphs, CAST(max(length(p)) AS BIGINT) AS longest
FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS p FROM documents) WHERE p <> '' GROUP BY 1"""
)
def paragraphs(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.explode(pages.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.max(F.length("p")).cast("long").alias("longest"))


#: Chunks of at most 128 tokens with an eighth of overlap: tokens with their offsets and the rank of the cut before each, then one chunk after the other.
_CHUNKS = r"""parts AS (
  SELECT doc_id AS key, text, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM documents
), numbered AS (
  SELECT key, text, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM parts WHERE len(w) > 0
), placed AS (
  SELECT key, i, w, g, CAST(sum(length(g) + length(w)) OVER (PARTITION BY key ORDER BY i) AS BIGINT) AS e, lag(w) OVER (PARTITION BY key ORDER BY i) AS before FROM numbered
), ranked AS (
  SELECT key, list(e - length(w) ORDER BY i) AS starts, list(e ORDER BY i) AS ends, count(*) AS n,
    list(CASE WHEN i = 0 THEN 0 WHEN length(g) - length(replace(g, chr(10), '')) > 1 THEN 2 WHEN contains(g, chr(10)) OR right(before, 1) IN ('.', '!', '?', ';', '。', '！', '？', '；') THEN 1 ELSE 0 END ORDER BY i) AS ranks
  FROM placed GROUP BY key
), cuts AS (
  SELECT key, n, ranks, 0 AS idx, CAST(0 AS BIGINT) AS first, CASE WHEN n <= 128 THEN n ELSE 64 + 65 - list_position(list_reverse(ranks[65:129]), list_max(ranks[65:129])) END AS cut FROM ranked
  UNION ALL
  SELECT key, n, ranks, idx + 1, f, CASE WHEN n - f <= 128 THEN n ELSE f + 64 + 65 - list_position(list_reverse(ranks[f + 65:f + 129]), list_max(ranks[f + 65:f + 129])) END
  FROM (SELECT key, n, ranks, idx, cut - CAST(least(floor((cut - first) * 0.125 + 0.5), cut - first - 1) AS BIGINT) AS f FROM cuts WHERE cut < n)
), chunks AS (
  SELECT c.key, c.idx, substr(text, CAST(starts[first + 1] AS BIGINT) + 1, CAST(ends[cut] - starts[first + 1] AS BIGINT)) AS text, CAST(starts[first + 1] AS INTEGER) AS char_start, CAST(ends[cut] AS INTEGER) AS char_end, CAST(cut - first AS INTEGER) AS tokens
  FROM cuts c JOIN ranked USING (key) JOIN parts USING (key)
)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT CAST(key AS VARCHAR) AS key, CAST(idx AS INTEGER) AS idx, text, char_start, char_end, substr(sha256(text), 1, 16) AS content_hash, tokens FROM chunks")
def chunked_text(spark, sf_dir):
    return pages.chunk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))


@query(
    f"""WITH RECURSIVE {_CHUNKS}, {_PAGES}, exact AS (SELECT key, page, start, start + len - CASE WHEN page = n_pages - 1 THEN 1 ELSE 0 END AS stop FROM r WHERE status = 'ok')
SELECT CAST(c.key AS VARCHAR) AS key, CAST(c.idx AS INTEGER) AS idx, char_start,
  CASE WHEN e.page IS NOT NULL THEN CAST(e.page + 1 AS VARCHAR) WHEN d.doc_id % 7 = 3 THEN CAST(least(3, CAST(floor(char_start / (length(d.text) / 3)) AS BIGINT) + 1) AS VARCHAR) END AS page_label,
  e.page IS NULL AND d.doc_id % 7 = 3 AS estimated
FROM chunks c JOIN documents d ON d.doc_id = c.key LEFT JOIN exact e ON e.key = c.key AND c.char_start >= e.start AND c.char_start < e.stop"""
)
def chunk_pages(spark, sf_dir):
    """Page labels of the chunks of documents whose lines are read as pages."""
    texts = _paged(spark, sf_dir)
    return pages.labelled_chunks(pages.chunk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")), texts).select("key", "idx", "char_start", "page_label", "estimated")


#: Chunks of at most 700 letters: running sums of the words' letters, then one chunk after the other.
_PIECES = r"""parts AS (SELECT doc_id AS key, text, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM documents
), numbered AS (SELECT key, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM parts WHERE len(w) > 0
), placed AS (SELECT key, i, w, g, CAST(sum(length(g) + length(w)) OVER (PARTITION BY key ORDER BY i) AS BIGINT) AS e, CAST(sum(length(w)) OVER (PARTITION BY key ORDER BY i) AS BIGINT) AS s, lag(w) OVER (PARTITION BY key ORDER BY i) AS before FROM numbered
), ranked AS (
  SELECT key, list(e - length(w) ORDER BY i) AS starts, list(e ORDER BY i) AS ends, list_concat([CAST(0 AS BIGINT)], list(s ORDER BY i)) AS sums, count(*) AS n,
    list_concat(list(CASE WHEN i = 0 THEN 0 WHEN length(g) - length(replace(g, chr(10), '')) > 1 THEN 2 WHEN contains(g, chr(10)) OR right(before, 1) IN ('.', '!', '?', ';', '。', '！', '？', '；') THEN 1 ELSE 0 END ORDER BY i), [2]) AS ranks
  FROM placed GROUP BY key
), edges AS (
  SELECT key, 0 AS idx, CAST(0 AS BIGINT) AS first, CAST(len(list_filter(sums, lambda x: x <= 700)) - 1 AS BIGINT) AS most, CAST(len(list_filter(sums, lambda x: x < 350)) AS BIGINT) AS low FROM ranked
), cuts AS (
  SELECT key, idx, first, CASE WHEN most >= n THEN n ELSE most + 1 - list_position(list_reverse(ranks[greatest(first + 1, least(most, low)) + 1:most + 1]), list_max(ranks[greatest(first + 1, least(most, low)) + 1:most + 1])) END AS cut FROM edges JOIN ranked USING (key)
  UNION ALL
  SELECT key, idx + 1, f, CASE WHEN most >= n THEN n ELSE most + 1 - list_position(list_reverse(ranks[greatest(f + 1, least(most, low)) + 1:most + 1]), list_max(ranks[greatest(f + 1, least(most, low)) + 1:most + 1])) END
  FROM (SELECT *, CAST(len(list_filter(sums, lambda x: x <= sums[f + 1] + 700)) - 1 AS BIGINT) AS most, CAST(len(list_filter(sums, lambda x: x < sums[f + 1] + 350)) AS BIGINT) AS low
    FROM (SELECT c.key, idx, n, ranks, sums, greatest(first + 1, CAST(len(list_filter(sums, lambda x: x < sums[cut + 1] - CAST(floor((sums[cut + 1] - sums[first + 1]) * 0.125 + 0.5) AS BIGINT))) AS BIGINT)) AS f FROM cuts c JOIN ranked USING (key) WHERE cut < n))
)"""


@query(
    f"""WITH RECURSIVE {_PIECES} SELECT CAST(c.key AS VARCHAR) AS key, CAST(idx AS INTEGER) AS idx, CAST(starts[first + 1] AS INTEGER) AS char_start, CAST(ends[cut] AS INTEGER) AS char_end, CAST(sums[cut + 1] - sums[first + 1] AS INTEGER) AS tokens FROM cuts c JOIN ranked USING (key)"""
)
def chunks_by_pieces(spark, sf_dir):
    """Chunks of at most 700 pieces under a vocabulary of single characters, in which a word weighs its letters."""
    single = lambda word: [1] * len(word)
    return pages.chunk(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), 700, lengths_of=single).select("key", "idx", "char_start", "char_end", "tokens")


@query(
    """SELECT l_orderkey AS key, substr(sha256(string_agg(h, '|' ORDER BY l_linenumber, h)), 1, 16) AS content_hash, count(*) AS n_chunks
FROM (SELECT l_orderkey, l_linenumber, substr(sha256(l_partkey || '/' || l_suppkey), 1, 16) AS h FROM lineitem) GROUP BY 1"""
)
def item_fingerprints(spark, sf_dir):
    h = F.substring(F.sha2(F.concat_ws("/", "l_partkey", "l_suppkey").cast("binary"), 256), 1, 16)
    return pages.fingerprint(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("idx"), h.alias("content_hash")))


@query("SELECT o_orderkey AS key, o_custkey AS version FROM orders WHERE o_custkey > 1000")
def manifest_since(spark, sf_dir):
    return index.since(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("version")), 1000)


@query("SELECT greatest(1000, least((SELECT max(o_custkey) FROM orders), (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'P' AND o_custkey > 1200) - 1)) AS watermark")
def next_watermark(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("version"), "o_orderstatus")
    return index.next_watermark(orders, orders.where("o_orderstatus = 'P' and version > 1200"), 1000)


_CURRENT = "SELECT doc_id AS key, md5(text) AS content_hash, n_chars AS n_chunks FROM documents"
_STORED = "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS content_hash, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_chunks FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT item_id + 10000000, md5(text), 1 FROM benchmark"


def _states(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    current = docs.select(d.alias("key"), F.md5("text").alias("content_hash"), F.col("n_chars").alias("n_chunks"))
    stored = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        d.alias("key"), F.when(d % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("content_hash"), (F.col("n_chars") + F.when(d % 5 == 0, 1).otherwise(0)).alias("n_chunks")
    )
    return current, stored.unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 10000000).alias("key"), F.md5("text").alias("content_hash"), F.lit(1).cast("long").alias("n_chunks")))


@query(f"WITH c AS ({_CURRENT}), s AS ({_STORED}) SELECT c.* FROM c LEFT JOIN s USING (key) WHERE c.content_hash IS DISTINCT FROM s.content_hash OR c.n_chunks IS DISTINCT FROM s.n_chunks")
def incremental_changed(spark, sf_dir):
    return index.changed(*_states(spark, sf_dir))


@query(f"WITH c AS ({_CURRENT}), s AS ({_STORED}) SELECT key FROM s WHERE key NOT IN (SELECT key FROM c)")
def incremental_vanished(spark, sf_dir):
    current, stored = _states(spark, sf_dir)
    return index.vanished(stored, current)


@query(f"WITH c AS ({_CURRENT}), s AS ({_STORED}) SELECT * FROM c")
def incremental_merged(spark, sf_dir):
    """Stored state brought up to date: it must equal the current state."""
    current, stored = _states(spark, sf_dir)
    return index.merged(stored, index.changed(current, stored), current)


#: The chunks of the index that two updates and a compaction leave: all documents but those that vanished, with the pages they begin on.
_INDEXED = f"""{_CHUNKS}, {_PAGES}, exact AS (SELECT key, page, start, start + len - CASE WHEN page = n_pages - 1 THEN 1 ELSE 0 END AS stop FROM r WHERE status = 'ok'
), indexed AS (
  SELECT c.key, c.idx, c.text, c.char_start, CASE WHEN e.page IS NOT NULL THEN CASE WHEN e.page % 2 = 0 THEN 'S' || (e.page + 1) ELSE CAST(e.page + 1 AS VARCHAR) END
    WHEN d.doc_id % 7 = 3 THEN CASE WHEN least(2, floor(char_start / (length(d.text) / 3))) % 2 = 0 THEN 'S' ELSE '' END || CAST(least(3, CAST(floor(char_start / (length(d.text) / 3)) AS BIGINT) + 1) AS VARCHAR) END AS page_label,
    e.page IS NULL AND d.doc_id % 7 = 3 AS estimated
  FROM chunks c JOIN documents d ON d.doc_id = c.key LEFT JOIN exact e ON e.key = c.key AND c.char_start >= e.start AND c.char_start < e.stop WHERE c.key % 7 <> 2
)"""


def _index(spark, sf_dir) -> str:
    """The folder of an index that was built, updated and compacted: a third of the documents come late, a fifth in a new version, a seventh vanish.

    Lines are read as pages, every seventh text claims three; pages have labels on every other page only.
    """
    folder, model = f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", semantic.character_embedder(16)
    d, late, renewed = F.col("doc_id"), F.col("doc_id") % 3 == 1, F.col("doc_id") % 5 == 0
    docs = table(spark, sf_dir, "documents").select(d, "text", F.when(d % 7 == 3, 3).alias("pages"))
    n = F.greatest(F.size(F.split("text", "\n")), F.lit(3))
    docs = docs.withColumn("labels", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, F.concat(F.lit("S"), (i + 1).cast("string"))).otherwise("")))
    first = docs.where(~late).select(d.alias("key"), F.when(renewed, F.concat("text", F.lit(" of old"))).otherwise(F.col("text")).alias("text"), "pages", "labels")
    semantic.update(folder, first, first.select("key", F.lit(1).alias("version")), model, separator="\n")
    second = docs.where(d % 7 != 2).select(d.alias("key"), "text", "pages", "labels", F.when(late | renewed, 2).otherwise(1).alias("version"))
    semantic.update(folder, second.drop("version"), second.select("key", "version"), model, separator="\n")
    semantic.compact(spark, folder, model)
    semantic.vacuum(spark, folder)
    return folder


@query(
    f"""WITH RECURSIVE {_INDEXED}, why AS (SELECT status, count(*) AS n FROM s JOIN (SELECT DISTINCT key FROM indexed) USING (key) WHERE status <> 'ok' GROUP BY 1)
SELECT count(DISTINCT key) AS items, count(*) AS chunks, count(*) FILTER (WHERE page_label IS NOT NULL AND NOT estimated) AS precise, count(*) FILTER (WHERE page_label IS NOT NULL AND estimated) AS estimated, count(*) FILTER (WHERE page_label IS NULL) AS unlabelled,
  CAST(2 AS BIGINT) AS watermark, 1 AS runs, (SELECT string_agg(status || ': ' || n, ', ' ORDER BY n DESC, status) FROM why) AS degraded FROM indexed"""
)
def index_status(spark, sf_dir):
    rows = semantic.status(spark, _index(spark, sf_dir))
    return rows.select("items", "chunks", "precise", "estimated", "unlabelled", "watermark", "runs", F.array_join("degraded", ", ").alias("degraded"))


@query(
    f"""WITH RECURSIVE {_INDEXED}, c AS (SELECT key, idx, char_start, page_label, estimated, list_transform(string_split(text, ''), lambda x: unicode(x) % 16) AS codes FROM indexed
), q AS (SELECT list_transform(string_split('the vector of a query', ''), lambda x: unicode(x) % 16) AS codes
), v AS (SELECT c.*, list_transform(range(16), lambda k: CAST(len(list_filter(c.codes, lambda x: x = k)) AS DOUBLE)) AS a, list_transform(range(16), lambda k: CAST(len(list_filter(q.codes, lambda x: x = k)) AS DOUBLE)) AS b FROM c, q)
SELECT CAST(key AS VARCHAR) AS key, CAST(idx AS INTEGER) AS idx, char_start, page_label, estimated, round(list_cosine_similarity(a, b), 4) AS score FROM v ORDER BY list_cosine_similarity(a, b) DESC, CAST(key AS VARCHAR), idx LIMIT 20"""
)
def semantic_hits(spark, sf_dir):
    hits = semantic.search(spark, _index(spark, sf_dir), "the vector of a query", semantic.character_embedder(16), 20)
    return hits.select("key", "idx", "char_start", "page_label", "estimated", F.round("score", 4).alias("score"))


_QUERY = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)"
_HITS = f"SELECT vec_id, label, list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_QUERY}) AS d FROM embeddings"


def _first_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT vec_id, round(d, 6) AS distance, round(greatest(-1, least(1, 1 - d * d / 2)), 6) AS score FROM ({_HITS}) ORDER BY d, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)
    return hits.select("vec_id", F.round("distance", 6).alias("distance"), F.round(vectors.score_of(F.col("distance")), 6).alias("score"))


@query(f"SELECT label, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM ({_HITS})) WHERE r = 1")
def best_hit_per_item(spark, sf_dir):
    q = F.array(*[F.lit(x) for x in _first_vector(spark, sf_dir)])
    hits = table(spark, sf_dir, "embeddings").select("label", "vec_id", (-vectors.l2_distance(F.col("embedding"), q)).alias("score"))
    return vectors.best_hit_per_item(hits, "label", "score", "vec_id").select("label", "vec_id", F.round(-F.col("score"), 6).alias("distance"))


@query(
    f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS r FROM ({_HITS}) WHERE vec_id <> 0), l AS (SELECT label FROM embeddings WHERE vec_id = 0)
SELECT count(*) FILTER (WHERE r = 1 AND h.label = l.label) > 0 AS top1, count(*) FILTER (WHERE r <= 10 AND h.label = l.label) AS in_top10, count(*) FILTER (WHERE h.label = l.label) AS relevant,
  round(count(*) FILTER (WHERE r <= 10 AND h.label = l.label) / 10, 6) AS precision10 FROM h, l"""
)
def retrieval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = rows.where("vec_id = 0").first()["label"]
    hits = vectors.nearest(rows.where("vec_id <> 0"), _first_vector(spark, sf_dir), 10)
    best = hits.agg(F.min_by("label", F.struct("distance", "vec_id")).alias("first"), F.count_if(F.col("label") == label).alias("in_top10"))
    return best.join(rows.where("vec_id <> 0").agg(F.count_if(F.col("label") == label).alias("relevant"))).select(
        (F.col("first") == label).alias("top1"), "in_top10", "relevant", F.round(F.col("in_top10") / 10, 6).alias("precision10")
    )


_MANY = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, ['de', 'en', 'fr', 'es'][vec_id % 4 + 1] AS lang, CASE WHEN vec_id % 60 > 0 THEN label END AS expected, vec_id % 9 / 10.0 AS unknown_rate, v AS qv FROM e WHERE vec_id % 15 = 0
), h AS (SELECT query_id, vec_id AS id, label AS item, list_distance(v, qv) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, qv), vec_id) AS rank FROM q JOIN e ON vec_id <> query_id QUALIFY rank <= 10)"""


def _many(spark, sf_dir):
    v, d = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    queries = v.where(d % 15 == 0).select(d.alias("query_id"), "embedding", F.get(F.array(*map(F.lit, ("de", "en", "fr", "es"))), (d % 4).cast("int")).alias("lang"), F.when(d % 60 > 0, F.col("label")).alias("expected"), (d % 9 / 10).alias("unknown_rate"))
    return queries, vectors.nearest_many(v.select(d.alias("id"), "embedding"), queries.select("query_id", "embedding"), 10)


@query(f"WITH {_MANY} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM h")
def nearest_to_many(spark, sf_dir):
    return _many(spark, sf_dir)[1].withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {_MANY}, p AS (SELECT query_id, coalesce(bool_or(item = expected AND rank = 1), false) AS first, coalesce(bool_or(item = expected), false) AS among, max(greatest(-1, least(1, 1 - distance * distance / 2))) AS best FROM h JOIN q USING (query_id) GROUP BY 1)
SELECT lang, count(expected) AS queries, round(count(*) FILTER (WHERE expected IS NOT NULL AND first) / nullif(count(expected), 0), 4) AS top1, round(count(*) FILTER (WHERE expected IS NOT NULL AND among) / nullif(count(expected), 0), 4) AS in_top,
  round(avg(unknown_rate), 4) AS unknown_rate, count(*) FILTER (WHERE expected IS NULL) AS negatives, round(max(best) FILTER (WHERE expected IS NULL), 4) AS highest_negative FROM q LEFT JOIN p USING (query_id) GROUP BY 1"""
)
def retrieval_by_language(spark, sf_dir):
    """Hits of many queries held against expected labels, by language, with queries that nothing answers."""
    queries, hits = _many(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("item"))
    hits = hits.join(labels, "id").withColumn("score", vectors.score_of(F.col("distance")))
    return vectors.retrieval_report(queries.drop("embedding"), hits)


@query(
    r"""WITH s AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS v FROM benchmark UNION ALL SELECT 1000000 + item_id, substr(regexp_replace(text, '\s+', '', 'g'), 1, 9) FROM benchmark
), t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS v FROM documents) SELECT item_id AS string_id, doc_id AS text_id FROM s JOIN t ON contains(t.v, s.v) WHERE s.v <> ''"""
)
def contained_passages(spark, sf_dir):
    """Documents that hold a benchmark passage or its first nine characters, white space aside."""
    b = table(spark, sf_dir, "benchmark")
    short = F.substring(containment.squeezed(F.col("text")), 1, 9)
    strings = b.select(F.col("item_id").alias("id"), F.col("text").alias("value")).unionByName(b.select((F.col("item_id") + 1000000).alias("id"), short.alias("value")))
    return containment.containing(strings, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value")))


@query(
    f"""WITH {_PAGES}, g AS (SELECT r.key, page, regexp_replace(substr(text, CAST(start AS BIGINT) + 1, CAST(len AS BIGINT)), '\\s+', '', 'g') AS segment, regexp_replace(substr(text, CAST(start AS BIGINT) + 1 + CASE WHEN page % 10 = 3 THEN 30 ELSE 0 END, 25), '\\s+', '', 'g') AS head FROM r JOIN documents ON doc_id = r.key)
SELECT count(*) AS pages, count(*) FILTER (WHERE head <> '' AND contains(segment, head)) AS matched, round(count(*) FILTER (WHERE head <> '' AND contains(segment, head)) / count(*), 4) AS share FROM g"""
)
def page_head_matches(spark, sf_dir):
    """Lines as pages: whether the 25 characters at a page's start (on some pages, 30 further on) stand in its segment."""
    rows = pages.page_table(_paged(spark, sf_dir)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), "key")
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    head = F.substring("text", F.col("start") + 1 + F.when(F.col("page") % 10 == 3, 30).otherwise(0), F.lit(25))
    return containment.page_heads(rows.select("key", "page", head.alias("head")), rows.select("key", "page", text.alias("text")))


@query(
    """WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT label, CAST(i AS INTEGER) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM m"""
)
def mean_pool(spark, sf_dir):
    return vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label").select("label", "i", F.round("v", 6).alias("v"))
