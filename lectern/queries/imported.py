"""Queries of identifier services, over answers composed from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import imports
from lectern.queries import query, table


def answers(spark, sf_dir):
    """Two attempts a part: a translation service that answers one in five, then the service of its identifier's kind."""
    k, t = F.col("p_partkey"), F.col("p_name")
    people = F.array(F.struct(F.lit("Ada").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("family")))
    parts = F.array(F.array(F.lit(1990) + F.col("p_size"), F.lit(3)))
    work = F.struct(F.array(t).alias("title"), F.concat(F.lit("10.1000/"), k).alias("DOI"), F.struct(parts.alias("date-parts")).alias("issued"), F.array(F.col("p_type")).alias("container-title"), F.lit("").alias("volume"), F.lit("<jats:p>About  it</jats:p>").alias("abstract"), people.alias("author"))
    book = F.struct(F.when(k % 7 != 0, t).alias("title"), F.lit("978").alias("isbn_13"), F.array(F.col("p_brand")).alias("publishers"), (F.col("p_size") + 100).alias("number_of_pages"), F.sequence(F.lit(1), F.lit(12)).cast("array<string>").alias("subjects"))
    summary = F.struct(F.concat(t, F.lit("  \n x")).alias("title"), F.col("p_type").alias("source"), F.array(F.struct(F.lit("pubmed").alias("idtype"), F.lit("1").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.lit("10.2/p").alias("value"))).alias("articleids"), F.array(F.struct(F.lit("Jane van Doe").alias("name")), F.struct(F.lit("Solo").alias("name"))).alias("authors"))
    kind = F.when(k % 3 == 0, "crossref").when(k % 3 == 1, "openlibrary").otherwise("pubmed")
    body = F.when(k % 3 == 0, F.to_json(F.struct(work.alias("message")))).when(k % 3 == 1, F.to_json(book)).otherwise(F.to_json(summary))
    own = F.struct(F.lit(2).alias("rank"), kind.alias("source"), F.when(k % 11 == 0, 404).otherwise(200).alias("status"), body.alias("body"))
    item = F.to_json(F.struct(F.lit("report").alias("itemType"), t.alias("title"), F.lit("2001").alias("date")))
    first = F.struct(F.lit(1).alias("rank"), F.lit("translation").alias("source"), F.when(k % 5 == 0, 200).alias("status"), F.when(k % 5 == 0, item).alias("body"))
    return table(spark, sf_dir, "part").select(k.alias("key"), F.explode(F.array(first, own)).alias("a"), F.array(F.lit("Ann Mary Lee"), F.lit("")).alias("author_names")).select("key", "a.*", "author_names")


@query(
    """WITH t AS (SELECT p_partkey AS key, p_name AS n, p_brand AS brand, p_type AS kind, p_size AS size, p_partkey % 5 = 0 AS translated, p_partkey % 3 AS m, p_partkey % 11 = 0 AS missing, p_partkey % 7 = 0 AS untitled FROM part
), s AS (SELECT *, CASE WHEN translated THEN 'translation' WHEN missing OR (m = 1 AND untitled) THEN NULL WHEN m = 0 THEN 'crossref' WHEN m = 1 THEN 'openlibrary' ELSE 'pubmed' END AS source FROM t)
SELECT key, source, CASE source WHEN 'translation' THEN 'report' WHEN 'openlibrary' THEN 'book' WHEN 'crossref' THEN 'journalArticle' WHEN 'pubmed' THEN 'journalArticle' END AS item_type,
  CASE WHEN source = 'pubmed' THEN n || ' x' WHEN source IS NOT NULL THEN n END AS title, CASE source WHEN 'translation' THEN '2001' WHEN 'crossref' THEN (1990 + size) || '-03' END AS date,
  CASE WHEN source IN ('crossref', 'pubmed') THEN kind END AS container, CASE WHEN source = 'openlibrary' THEN brand END AS publisher, CASE source WHEN 'crossref' THEN '10.1000/' || key WHEN 'pubmed' THEN '10.2/p' END AS doi,
  CASE WHEN source = 'openlibrary' THEN CAST(size + 100 AS VARCHAR) END AS n_pages, CASE WHEN source = 'crossref' THEN 'About it' END AS abstract, CASE WHEN source = 'openlibrary' THEN 8 END AS n_tags,
  CASE source WHEN 'crossref' THEN brand || '/Ada' WHEN 'openlibrary' THEN 'Lee/Ann Mary' WHEN 'pubmed' THEN 'Doe/Jane van|Solo/' END AS people,
  CASE WHEN translated THEN 'translation: ok' ELSE 'translation: no answer|' || CASE m WHEN 0 THEN 'crossref' WHEN 1 THEN 'openlibrary' ELSE 'pubmed' END || ': ' || CASE WHEN missing THEN 'HTTP 404' WHEN m = 1 AND untitled THEN 'no title' ELSE 'ok' END END AS attempts
FROM s"""
)
def resolved_identifiers(spark, sf_dir):
    r = imports.resolve(answers(spark, sf_dir))
    people = F.array_join(F.transform("creators", lambda c: F.concat_ws("/", c["last"], c["first"])), "|")
    n_tags = F.when(F.col("tags").isNotNull(), F.size("tags"))
    return r.select("key", "source", "item_type", "title", "date", "container", "publisher", "doi", "n_pages", "abstract", n_tags.alias("n_tags"), people.alias("people"), F.array_join("attempts", "|").alias("attempts"))
