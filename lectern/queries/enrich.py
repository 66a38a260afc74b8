"""Queries of metadata enrichment, over service answers composed from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import enrichment
from lectern.queries import query, table


def _payloads(spark, sf_dir):
    """Answers of four services for each part: two of them fail for some."""
    k = F.col("p_partkey")
    s, nine = k.cast("string"), (k % 9).cast("string")
    t = table(spark, sf_dir, "part")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = lambda cond, *parts: F.when(cond, line('"', *parts, '"')).otherwise("null")
    flag = lambda cond: F.when(cond, "true").otherwise("false")
    bodies = {
        "openalex": line('{"id":"W', s, '","doi":"https://doi.org/10.1000/', s, '","cited_by_count":', (k % 50).cast("string"), ',"is_retracted":', flag(k % 11 == 0), ',"primary_location":{"source":{"display_name":"J', nine, '","abbreviated_title":', text(k % 2 == 0, "J. ", nine), '}},"ids":{"pmcid":', text(k % 5 == 0, "PMC", (k + 100000).cast("string")), "}}"),
        "semanticscholar": line('{"paperId":"S', s, '","citationCount":', (k % 40).cast("string"), ',"influentialCitationCount":', (k % 4).cast("string"), ',"openAccessPdf":{"url":', text(k % 4 == 1, "https://s2/", s), ',"license":null},"externalIds":{"DOI":"10.1000/', s, '.","PubMedCentral":null}}'),
        "crossref": line('{"message":{"DOI":"10.1000/', s, '","container-title":["J', nine, '"],"short-container-title":[', F.when(k % 3 == 0, line('"CR ', nine, '"')).otherwise(""), '],"updated-by":[', F.when(k % 13 == 0, line('{"type":"retraction","DOI":"10.9/', s, '","label":"Retraction"}')).otherwise(""), '],"update-to":[]}}'),
        "unpaywall": line('{"doi":"10.1000/', s, '","is_oa":', flag(k % 6 < 2), ',"oa_status":"gold","best_oa_location":{"url_for_pdf":null,"url":"https://oa/', s, '","license":"cc-by"}}'),
    }
    statuses = {"openalex": F.when(k % 7 == 0, 404).otherwise(200), "semanticscholar": F.when(k % 3 == 0, 500).otherwise(200), "crossref": F.lit(200), "unpaywall": F.lit(200)}
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(i).alias("rank"), statuses[n].alias("status"), b.alias("body")) for i, (n, b) in enumerate(bodies.items())])
    return t.select(k.alias("key"), F.explode(rows).alias("r")).select("key", "r.*")


#: What the answers above say, computed from the keys.
_EXPECTED = """e AS (SELECT p_partkey AS key, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, CAST(p_partkey % 9 AS VARCHAR) AS nine, p_partkey % 7 <> 0 AS oa, p_partkey % 3 <> 0 AS s2 FROM part
), m AS (SELECT key, k, '10.1000/' || s AS doi, CASE WHEN oa THEN k % 50 END AS cited_by, CASE WHEN s2 THEN k % 40 END AS citations, CASE WHEN s2 THEN k % 4 END AS influential,
  (oa AND k % 11 = 0) OR k % 13 = 0 AS retracted, array_to_string(list_filter([CASE WHEN oa AND k % 11 = 0 THEN 'openalex' END, CASE WHEN k % 13 = 0 THEN 'crossref' END], lambda x: x IS NOT NULL), ', ') AS retraction_sources,
  CASE WHEN k % 13 = 0 THEN 'Retraction' END AS retraction_label, CASE WHEN k % 13 = 0 THEN '10.9/' || s END AS retraction_doi,
  CASE WHEN k % 3 = 0 THEN 'CR ' || nine WHEN oa AND k % 2 = 0 THEN 'J. ' || nine END AS abbreviation, CASE WHEN k % 3 = 0 THEN 'crossref' WHEN oa AND k % 2 = 0 THEN 'openalex' END AS abbreviation_source,
  CASE WHEN k % 6 < 2 THEN 'unpaywall' WHEN s2 AND k % 4 = 1 THEN 'semanticscholar' WHEN oa AND k % 5 = 0 THEN 'pmc' END AS oa_source, CASE WHEN oa AND k % 5 = 0 THEN CAST(k + 100000 AS VARCHAR) END AS pmc_id, s FROM e
), x AS (SELECT *, CASE oa_source WHEN 'unpaywall' THEN 'https://oa/' || s WHEN 'semanticscholar' THEN 'https://s2/' || s WHEN 'pmc' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || pmc_id || '/' END AS oa_url,
  CASE oa_source WHEN 'unpaywall' THEN 'cc-by' END AS oa_license, CASE oa_source WHEN 'unpaywall' THEN 'gold' WHEN 'pmc' THEN 'pmc' END AS oa_status FROM m)"""


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (WHERE retracted) AS n_retracted, count(doi) AS n_doi, count(oa_url) AS n_open FROM (
  SELECT 'openalex' AS source, p_partkey % 11 = 0 AS retracted, 1 AS doi, NULL AS oa_url FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT 'semanticscholar', false, 1, CASE WHEN p_partkey % 4 = 1 THEN 1 END FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT 'crossref', p_partkey % 13 = 0, 1, NULL FROM part UNION ALL SELECT 'unpaywall', false, 1, CASE WHEN p_partkey % 6 < 2 THEN 1 END FROM part) GROUP BY 1"""
)
def source_records(spark, sf_dir):
    r = enrichment.records(_payloads(spark, sf_dir))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("retracted").alias("n_retracted"), F.count("doi").alias("n_doi"), F.count("oa_url").alias("n_open"))


@query(f"WITH {_EXPECTED} SELECT * EXCLUDE (k, s) FROM x")
def merged_intelligence(spark, sf_dir):
    return enrichment.merge(enrichment.records(_payloads(spark, sf_dir))).withColumn("retraction_sources", F.array_join("retraction_sources", ", "))


@query(
    """SELECT key, 4 AS n_sources, n AS n_hits, CASE WHEN n = 4 THEN 'enriched' ELSE 'partial' END AS state FROM (SELECT p_partkey AS key, CAST(2 + (p_partkey % 7 <> 0)::INT + (p_partkey % 3 <> 0)::INT AS BIGINT) AS n FROM part)""".replace("4 AS n_sources", "CAST(4 AS BIGINT) AS n_sources")
)
def enrichment_status(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    hits = enrichment.records(p).select("key", "source", F.lit(True).alias("hit"))
    return enrichment.item_status(p.select("key", "source", "status").join(hits, ["key", "source"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))


_BLOCK = """list_filter(['cited-by: ' || cited_by || ' · openalex', 'citations: ' || citations || ' · semanticscholar', 'influential-citations: ' || influential || ' · semanticscholar', 'journal-abbreviation: ' || abbreviation || ' · ' || abbreviation_source,
  'open-access: ' || coalesce(oa_status, 'yes') || ' · ' || oa_url || coalesce(' · ' || oa_license, '') || ' · ' || oa_source, CASE WHEN retracted THEN 'retracted: yes · ' || retraction_sources || coalesce(' · notice ' || retraction_doi, '') END], lambda x: x IS NOT NULL)"""


@query(
    f"""WITH {_EXPECTED}, b AS (SELECT *, '<!-- enrichment:start -->' || chr(10) || 'enrichment · 2024-01-01' || chr(10) || array_to_string({_BLOCK}, chr(10)) || chr(10) || '<!-- enrichment:end -->' AS block, len({_BLOCK}) AS n_lines FROM x)
SELECT key, CASE WHEN n_lines = 0 THEN CASE WHEN k % 2 = 0 THEN 'note' END WHEN k % 2 = 0 THEN 'note' || chr(10) || block ELSE block END AS extra, CASE WHEN k % 5 = 1 THEN 'Old' ELSE abbreviation END AS abbreviation,
  array_to_string(list_filter(['a', CASE WHEN retracted THEN 'retracted' END, CASE WHEN oa_url IS NOT NULL THEN 'open-access' END], lambda t: t IS NOT NULL), ',') AS tags, coalesce(k % 5 = 1 AND abbreviation <> 'Old', false) AS skipped FROM b"""
)
def enrichment_writes(spark, sf_dir):
    """Write set of the merged records; applying it twice is the same as once."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(
        k.alias("key"), F.when(k % 2 == 0, "note").alias("extra"), F.when(k % 5 == 1, "Old").alias("abbreviation"), F.array(F.lit("a")).alias("tags"), F.lit("enriched").alias("state")
    )
    merged = enrichment.merge(enrichment.records(_payloads(spark, sf_dir)))
    once = enrichment.write_set(merged, items, "2024-01-01")
    twice = enrichment.write_set(merged, once.select("key", "extra", F.when(F.col("skipped"), F.lit("Old")).otherwise(F.col("abbreviation")).alias("abbreviation"), "tags", F.lit("enriched").alias("state")), "2025-05-05")
    return twice.select("key", F.nullif("extra", F.lit("")).alias("extra"), "abbreviation", F.array_join("tags", ",").alias("tags"), "skipped")


@query("SELECT p_partkey AS key, 'https://arxiv.org/abs/' || p_partkey AS id, p_name || ' & co' AS title, '10.1000/' || p_partkey AS doi, 'https://arxiv.org/pdf/' || p_partkey AS pdf_url, CASE WHEN p_partkey % 2 = 0 THEN 'https://cc/by' END AS license FROM part")
def preprint_feed(spark, sf_dir):
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    feed = F.concat(
        F.lit('<feed xmlns="x"><entry><id> http://arxiv.org/abs/'), k, F.lit("</id><title>"), name, F.lit(' &amp;\n  co</title><arxiv:doi xmlns:arxiv="y">10.1000/'), k,
        F.lit('.</arxiv:doi><link rel="related" title="pdf" href="https://arxiv.org/pdf/'), k, F.lit('"/>'), F.when(F.col("p_partkey") % 2 == 0, '<link rel="license" href="https://cc/by"/>').otherwise(""), F.lit("</entry></feed>"),
    )
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), enrichment.arxiv_record(feed).alias("r"))
    return t.select("key", "r.*")


@query(
    """WITH e AS (SELECT p_partkey AS key, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s FROM part)
SELECT key, '10.1000/' || CASE WHEN k % 3 > 0 THEN 'P' ELSE 'x' END || s AS doi, k % 4 = 0 AS retracted, CASE WHEN k % 4 = 0 THEN 'pubmed' ELSE '' END AS retraction_sources, CASE WHEN k % 4 = 0 THEN 'Retracted Publication' END AS retraction_label,
  'J Med' AS abbreviation, 'pubmed' AS abbreviation_source, CASE WHEN k % 5 > 0 THEN 'arxiv' WHEN k % 2 = 0 THEN 'pmc' END AS oa_source,
  CASE WHEN k % 5 > 0 THEN 'https://arxiv.org/pdf/2101.' || s WHEN k % 2 = 0 THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || (k + 100000) || '/' END AS oa_url, CASE WHEN k % 5 > 0 THEN 'https://license/' || s END AS oa_license, CASE WHEN k % 2 = 0 THEN CAST(k + 100000 AS VARCHAR) END AS pmc_id
FROM e WHERE k % 7 > 0
UNION ALL SELECT key, '10.1000/x' || s, false, '', NULL, NULL, NULL, CASE WHEN k % 5 > 0 THEN 'arxiv' END, CASE WHEN k % 5 > 0 THEN 'https://arxiv.org/pdf/2101.' || s END, CASE WHEN k % 5 > 0 THEN 'https://license/' || s END, NULL FROM e WHERE k % 7 = 0"""
)
def summaries_and_preprints(spark, sf_dir):
    """Article summaries, some without a DOI or missing, and feeds of a preprint server, some without a PDF link, merged by item."""
    k = F.col("p_partkey")
    s = k.cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda cond, *parts: F.when(cond, line(*parts)).otherwise("")
    summary = line(
        '{"summary":{"pubtype":["Journal Article"', some(k % 4 == 0, ',"Retracted Publication"'), '],"source":" J Med ","articleids":[{"idtype":"pubmed","value":"', s, '"}', some(k % 3 > 0, ',{"idtype":"doi","value":"10.1000/P', s, '"}'), some(k % 2 == 0, ',{"idtype":"pmc","value":"PMC', (k + 100000).cast("string"), '"}'), "]}}"
    )
    feed = line(
        "<feed><entry><id>http://arxiv.org/abs/2101.", s, "</id><title>Of part ", s, "</title><arxiv:doi xmlns:arxiv='a'>10.1000/x", s, '</arxiv:doi><link rel="license" href="https://license/', s, '"/>',
        some(k % 5 > 0, '<link title="pdf" rel="related" href="https://arxiv.org/pdf/2101.', s, '"/>'), "</entry><entry><id>http://other</id></entry></feed>",
    )
    row = lambda source, rank, status, body: F.struct(F.lit(source).alias("source"), F.lit(rank).alias("rank"), status.alias("status"), body.alias("body"))
    answers = F.array(row("pubmed", 0, F.when(k % 7 == 0, 404).otherwise(200), summary), row("arxiv", 1, F.lit(200), feed))
    merged = enrichment.merge(enrichment.records(table(spark, sf_dir, "part").select(k.alias("key"), F.explode(answers).alias("r")).select("key", "r.*")))
    return merged.select("key", "doi", "retracted", F.array_join("retraction_sources", ", ").alias("retraction_sources"), "retraction_label", "abbreviation", "abbreviation_source", "oa_source", "oa_url", "oa_license", "pmc_id")
