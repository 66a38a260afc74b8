"""Queries over the catalogue: statistics, search, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import dedupe, stats
from lectern.queries import query, table
from lectern.sources.tables import attachments, catalogue

#: The catalogue and its attachments in SQL, for the statements below.
ITEMS = """items AS (
  SELECT p_partkey AS key, p_type AS item_type, p_name AS title, p_brand AS author,
    CASE WHEN p_size < 48 THEN 'May ' || CAST(p_size + 1970 AS VARCHAR) END AS date,
    CASE WHEN p_partkey % 20 < 2 THEN (CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1000/X' WHEN 1 THEN 'doi: 10.1000/x' ELSE '10.1000/X' END) || CAST(p_partkey // 20 AS VARCHAR) END AS doi,
    CASE WHEN p_partkey % 4 > 0 THEN ['C' || CAST(p_partkey % 4 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS collections
  FROM part
), attachments AS (
  SELECT l_partkey AS parent, CASE WHEN l_returnflag = 'A' THEN 'application/pdf' ELSE 'text/html' END AS content_type, year(l_shipdate) AS year FROM lineitem
), candidates AS (
  SELECT key, item_type, trim(regexp_replace(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) +', '')) AS title_key,
    nullif(regexp_replace(lower(strip_accents(author)), '[^a-z0-9]+', '', 'g'), '') AS author_key,
    TRY_CAST(nullif(regexp_extract(date, '(\\d{4})', 1), '') AS INTEGER) AS year,
    'doi:' || nullif(lower(trim(regexp_replace(regexp_replace(trim(doi), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:\\s*', '', 'i'))), '') AS strong_key
  FROM items
)"""

WEAK = """folded AS (
  SELECT item_type, title_key, author_key, year, min(key) AS rep, count(*) AS n FROM candidates WHERE title_key <> '' AND item_type IS NOT NULL GROUP BY ALL
), weak AS (
  SELECT greatest(a.rep, b.rep) AS src, least(a.rep, b.rep) AS dst, abs(a.year - b.year) AS year_gap
  FROM folded a JOIN folded b ON a.item_type = b.item_type
    AND ((a.year IS NULL AND b.year IS NOT NULL) OR (a.rep < b.rep AND abs(a.year - b.year) <= 1))
  WHERE jaro_winkler_similarity(a.title_key, b.title_key) >= 0.9
    AND (a.author_key IS NULL OR b.author_key IS NULL OR jaro_winkler_similarity(a.author_key, b.author_key) >= 0.9)
)"""

EDGES = """strong AS (
  SELECT key AS src, min(key) OVER (PARTITION BY strong_key) AS dst FROM candidates WHERE strong_key IS NOT NULL
), same AS (
  SELECT c.key AS src, f.rep AS dst FROM candidates c JOIN folded f
    ON c.item_type = f.item_type AND c.title_key = f.title_key AND c.author_key IS NOT DISTINCT FROM f.author_key AND c.year = f.year
), edges AS (
  SELECT src, dst FROM strong WHERE src <> dst UNION SELECT src, dst FROM weak UNION SELECT src, dst FROM same WHERE src <> dst
), both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges
), reach AS (
  SELECT src AS u, src AS v FROM both_ways
  UNION
  SELECT r.u, e.dst FROM reach r JOIN both_ways e ON e.src = r.v
), members AS (SELECT u AS key, min(v) AS cluster_id FROM reach GROUP BY u)"""


@query(
    f"""WITH {ITEMS}, pdf AS (SELECT DISTINCT parent FROM attachments WHERE content_type = 'application/pdf')
SELECT count(*) AS total_items, count(*) FILTER (WHERE pdf.parent IS NULL) AS missing_pdf, count(*) FILTER (WHERE coalesce(doi, '') = '') AS missing_doi,
  count(*) FILTER (WHERE coalesce(title, '') = '' OR date IS NULL OR coalesce(author, '') = '') AS missing_metadata, count(*) FILTER (WHERE len(collections) = 0) AS unfiled,
  (SELECT count(*) FROM (SELECT author FROM items WHERE author <> '' GROUP BY author HAVING count(*) > 1)) AS duplicate_creators
FROM items LEFT JOIN pdf ON parent = key"""
)
def library_stats(spark, sf_dir):
    return stats.library_stats(catalogue(spark, sf_dir), attachments(spark, sf_dir))


@query("SELECT coalesce(lang, 'unknown') AS item_type, count(*) AS n FROM documents GROUP BY 1")
def items_by_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("item_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS tag, count(*) AS n_items FROM events GROUP BY 1")
def tag_frequency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n_items"))


@query("SELECT count(*) AS duplicate_creators FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def repeated_creators(spark, sf_dir):
    return stats.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT o_orderkey AS key, count(l_linenumber) AS n_children, count(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS n_pdf FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def children_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("p"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return orders.join(lines, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("p", F.lit(0)).alias("n_pdf"))


@query(
    """WITH RECURSIVE c AS (
  SELECT 'R' || r_regionkey AS key, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation
), t AS (
  SELECT key, name, parent, name AS path, 0 AS level FROM c WHERE parent IS NULL OR parent NOT IN (SELECT key FROM c)
  UNION ALL SELECT c.key, c.name, c.parent, t.path || ' / ' || c.name, t.level + 1 FROM c JOIN t ON c.parent = t.key
), n AS (SELECT 'N' || c_nationkey AS key, count(*) AS n_items FROM customer GROUP BY 1)
SELECT key, name, parent, path, level, coalesce(n_items, 0) AS n_items FROM t LEFT JOIN n USING (key)"""
)
def collection_tree(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    counts = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("N"), "c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n_items"))
    return stats.collection_paths(region.unionByName(nation)).join(counts, "key", "left").select("key", "name", "parent", "path", "level", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query(f"WITH {ITEMS} SELECT key, item_type, title FROM items WHERE lower(title) LIKE '%bolt%' AND item_type = 'PROMO' AND list_contains(collections, 'C1') ORDER BY key LIMIT 25")
def search_keyword(spark, sf_dir):
    return stats.search(catalogue(spark, sf_dir), "Bolt", ["title", "author", "date"], item_type="PROMO", collection="C1").select("key", "item_type", "title")


@query("SELECT doc_id AS key, lang, source FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' ORDER BY doc_id LIMIT 100 OFFSET 25")
def search_fulltext(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("item_type"), "source", "text")
    return stats.search(docs, "THE", ["text"], item_type="en", limit=100, start=25).select("key", F.col("item_type").alias("lang"), "source")


@query(f"WITH {ITEMS} SELECT strong_key, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM candidates WHERE strong_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def strong_key_groups(spark, sf_dir):
    c = dedupe.candidates(catalogue(spark, sf_dir)).where("strong_key is not null")
    return c.groupBy("strong_key").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key")).where("n > 1")


@query(f"WITH {ITEMS}, {WEAK} SELECT * FROM weak")
def weak_pairs(spark, sf_dir):
    return dedupe.weak_pairs(dedupe.candidates(catalogue(spark, sf_dir))).select("src", "dst", "year_gap")


@query(
    f"""WITH {ITEMS}, {WEAK}, p AS (SELECT jaro_winkler_similarity(a.title_key, b.title_key) AS t, jaro_winkler_similarity(a.author_key, b.author_key) AS s, abs(a.year - b.year) AS gap FROM folded a JOIN folded b
  ON a.item_type = b.item_type AND ((a.year IS NULL AND b.year IS NOT NULL) OR (a.rep < b.rep AND abs(a.year // 2 - b.year // 2) <= 2)))
SELECT CASE WHEN t < 0.9 THEN 'title' WHEN gap > 1 THEN 'year' ELSE 'author' END AS reason, count(*) AS n FROM p WHERE t < 0.9 OR coalesce(gap > 1, false) OR coalesce(s < 0.9, false) GROUP BY 1"""
)
def rejected_pairs(spark, sf_dir):
    return dedupe.rejected_counts(dedupe.candidates(catalogue(spark, sf_dir)))


def _counts(spark, sf_dir):
    """Attachments of each item, and annotations: those of its attachments that are dated 1995."""
    return attachments(spark, sf_dir).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_attachments"), F.count_if(F.col("year") == 1995).alias("n_annotations"))


@query(
    f"""WITH RECURSIVE {ITEMS}, {WEAK}, {EDGES}, shared AS (SELECT strong_key FROM candidates WHERE strong_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1
), n AS (SELECT parent AS key, count(*) AS n_attachments, count(*) FILTER (WHERE year = 1995) AS n_annotations FROM attachments GROUP BY 1
), facts AS (
  SELECT m.cluster_id, m.key, c.title_key, s.strong_key, CASE WHEN s.strong_key IS NULL THEN 0 ELSE 3 END AS rank,
    row_number() OVER (PARTITION BY m.cluster_id ORDER BY coalesce(n.n_attachments, 0) DESC, coalesce(n.n_annotations, 0) DESC, len(i.collections) DESC,
      CAST(i.title <> '' AS INT) + CAST(coalesce(i.doi <> '', false) AS INT) + CAST(c.year IS NOT NULL AS INT) + CAST(coalesce(i.author <> '', false) AS INT) DESC, m.key) AS r
  FROM members m JOIN items i USING (key) JOIN candidates c USING (key) LEFT JOIN shared s ON s.strong_key = c.strong_key LEFT JOIN n USING (key)
), per AS (
  SELECT cluster_id, count(*) AS n_members, max(rank) AS best, min(strong_key) AS own, max(CASE WHEN r = 1 THEN key END) AS primary_key, max(CASE WHEN r = 1 THEN title_key END) AS t, max(CASE WHEN r = 1 THEN strong_key END) AS k
  FROM facts GROUP BY 1
)
SELECT f.cluster_id, f.key, n_members, CASE best WHEN 3 THEN 'doi' ELSE 'weak' END AS match_type, CASE WHEN best = 0 THEN t ELSE coalesce(k, own) END AS match_key, primary_key AS "primary"
FROM facts f JOIN per USING (cluster_id)"""
)
def duplicate_clusters(spark, sf_dir):
    return dedupe.clusters(catalogue(spark, sf_dir), _counts(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {ITEMS}, {WEAK}, {EDGES}, shared AS (SELECT strong_key FROM candidates WHERE strong_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1
), per AS (SELECT cluster_id, count(*) AS n, bool_or(s.strong_key IS NOT NULL) AS strong FROM members JOIN candidates c USING (key) LEFT JOIN shared s ON s.strong_key = c.strong_key GROUP BY 1)
SELECT count(*) AS clusters, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE NOT strong) AS weak, CAST(sum(n) AS BIGINT) AS items, CAST(sum(n - 1) AS BIGINT) AS surplus FROM per"""
)
def cluster_statistics(spark, sf_dir):
    return dedupe.cluster_statistics(dedupe.clusters(catalogue(spark, sf_dir), _counts(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {ITEMS}, {WEAK}, {EDGES}, reasons AS (
  SELECT key AS src, 'same ' || strong_key AS reason FROM (SELECT key, strong_key, min(key) OVER (PARTITION BY strong_key) AS dst FROM candidates WHERE strong_key IS NOT NULL) WHERE key <> dst
  UNION ALL SELECT src, 'same form' FROM same WHERE src <> dst
  UNION ALL SELECT src, 'title ' || printf('%.3f', jaro_winkler_similarity(a.title_key, b.title_key)) || coalesce(', author ' || printf('%.3f', jaro_winkler_similarity(a.author_key, b.author_key)), '')
    FROM weak JOIN candidates a ON a.key = src JOIN candidates b ON b.key = dst
) SELECT cluster_id, list_sort(list(DISTINCT reason)) AS reasons FROM reasons JOIN members ON members.key = src GROUP BY 1"""
)
def cluster_reasons(spark, sf_dir):
    items = catalogue(spark, sf_dir)
    return dedupe.cluster_reasons(dedupe.candidates(items), dedupe.clusters(items, _counts(spark, sf_dir)).select("key", "cluster_id"))


@query(
    f"""WITH RECURSIVE {ITEMS}, {WEAK}, {EDGES}, labelled AS (SELECT key, first_value(key) OVER (PARTITION BY item_type, title_key ORDER BY key) AS group_id FROM candidates
), p AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM members GROUP BY cluster_id)
), t AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM labelled GROUP BY group_id)
), b AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT count(*) AS n FROM members JOIN labelled USING (key) GROUP BY cluster_id, group_id))
SELECT CAST(b.v AS BIGINT) AS tp, CAST(p.v - b.v AS BIGINT) AS fp, CAST(t.v - b.v AS BIGINT) AS fn, round(b.v / p.v, 6) AS precision, round(b.v / t.v, 6) AS recall FROM p, t, b"""
)
def duplicate_metrics(spark, sf_dir):
    """Clusters held against the labelling 'same type and title'."""
    items = catalogue(spark, sf_dir)
    c = dedupe.candidates(items)
    labelled = c.join(c.groupBy("item_type", "title_key").agg(F.min("key").alias("group_id")), ["item_type", "title_key"]).select("key", "group_id")
    return dedupe.pair_metrics(dedupe.clusters(items, _counts(spark, sf_dir)).select("key", "cluster_id"), labelled)


@query(
    """WITH t AS (SELECT l_suppkey AS supplier, l_partkey AS key, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT supplier, key, n FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY n DESC, q DESC, key) AS r FROM t) WHERE r = 1"""
)
def pick_primary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return t.groupBy("supplier").agg(F.min_by(F.struct("key", "n"), F.struct(-F.col("n"), -F.col("q"), "key")).alias("p")).select("supplier", "p.key", "p.n")


@query(
    f"""WITH {ITEMS} SELECT key, title_key, length(title) >= 6 AND regexp_matches(trim(title), '\\s') AS lookup,
  CAST(title <> '' AS INT) + CAST(coalesce(doi <> '', false) AS INT) + CAST(year IS NOT NULL AS INT) + 1 AS fields FROM items JOIN candidates USING (key)"""
)
def item_facts(spark, sf_dir):
    i = catalogue(spark, sf_dir)
    return i.select(
        "key", tx.normalize_title("title").alias("title_key"), tx.title_for_lookup(F.col("title")).alias("lookup"),
        tx.completeness(F.col("title"), F.col("doi"), tx.first_year("date"), F.lit(1)).alias("fields"),
    )
