"""Queries of the small value functions and record-level choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import values
from lectern.operators import records
from lectern.queries import query, table
from lectern.sources.tables import attachments


@query(
    """SELECT p_partkey AS key, '{"a":[1,' || CASE WHEN p_partkey % 2 = 0 THEN '"x"' ELSE 'null' END || '],"name":"' || p_name || '","z":{"b":2,"c":null}}' AS canonical,
  replace('key ' || p_brand || ' of ' || p_brand, 'Brand#11', '***') AS redacted, 'plan-20260102030405-' || p_size || '-' || substr(md5(p_name), 1, 4) AS plan_id,
  CASE p_partkey % 4 WHEN 0 THEN 'bibtex' WHEN 1 THEN 'bib' WHEN 2 THEN 'csljson' END AS format, '|note|' || CASE WHEN p_partkey % 3 = 0 THEN '#000000' ELSE '#ffd400' END AS annotation FROM part"""
)
def plan_values(spark, sf_dir):
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    raw = F.concat(F.lit('{"z": {"c": "", "b": 2}, "name": "  '), F.col("p_name"), F.lit(' ", "a": [1, '), F.when(k % 2 == 0, '" x"').otherwise('""'), F.lit("]}"))
    a = values.with_annotation_defaults(F.lit(None).cast("string"), F.lit("note"), F.when(k % 3 == 0, "#000000"))
    wanted = F.when(k % 4 == 0, "bib").when(k % 4 == 1, "citation").when(k % 4 == 2, "csljson").otherwise("other")
    return p.select(
        k.alias("key"), values.canonical_json(raw).alias("canonical"), values.redacted(F.concat(F.lit("key "), "p_brand", F.lit(" of "), "p_brand"), "Brand#11").alias("redacted"),
        values.plan_id(F.lit("2026-01-02T03:04:05.678Z"), F.col("p_size"), F.substring(F.md5("p_name"), 1, 4)).alias("plan_id"), values.export_format(wanted).alias("format"), F.concat_ws("|", a["text"], a["comment"], a["colour"]).alias("annotation"),
    )


@query(
    """WITH l AS (SELECT doc_id, text || chr(10) || CASE doc_id % 6 WHEN 0 THEN ' Citation x UNDEFINED ' || chr(13) || chr(10) || 'ok' WHEN 1 THEN 'Not checked for MiKTeX updates' WHEN 2 THEN 'going to download' WHEN 3 THEN 'cannot contact the repository' WHEN 4 THEN 'MiKTeX: Connection timed out' ELSE 'File x.sty not found' END AS log FROM documents)
SELECT doc_id AS key, CAST(len(list_filter(regexp_split_to_array(log, '\\r?\\n'), lambda x: regexp_matches(x, '(?i)undefined'))) AS BIGINT) AS undefined,
  CASE doc_id % 6 WHEN 1 THEN 'updates' WHEN 2 THEN 'download' WHEN 3 THEN 'repository' WHEN 4 THEN 'network' END AS issue FROM l"""
)
def compiler_logs(spark, sf_dir):
    d = F.col("doc_id")
    tail = (
        F.when(d % 6 == 0, " Citation x UNDEFINED \r\nok").when(d % 6 == 1, "Not checked for MiKTeX updates").when(d % 6 == 2, "going to download")
        .when(d % 6 == 3, "cannot contact the repository").when(d % 6 == 4, "MiKTeX: Connection timed out").otherwise("File x.sty not found")
    )
    log = F.concat("text", F.lit("\n"), tail)
    return table(spark, sf_dir, "documents").select(d.alias("key"), F.size(values.undefined_lines(log)).cast("long").alias("undefined"), values.environment_issue(log).alias("issue"))


@query(
    """WITH a AS (SELECT l_orderkey || '-' || l_linenumber AS key, l_partkey AS parent, l_returnflag = 'A' AS is_pdf, year(l_shipdate) = 1995 AS noted FROM lineitem)
SELECT parent, key, is_pdf FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_pdf DESC, noted DESC, key) AS r FROM a) WHERE r = 1"""
)
def first_attachments(spark, sf_dir):
    return records.first_attachment(attachments(spark, sf_dir).withColumn("n_annotations", (F.col("year") == 1995).cast("int")))


@query(
    """SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 > 0 THEN 'first' ELSE 'second' END AS way, o_totalprice AS price FROM orders WHERE o_custkey % 3 > 0 OR o_orderstatus = 'F'"""
)
def united_annotations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = lambda df, way: df.select(F.col("o_orderkey").alias("key"), F.lit(way).alias("way"), F.col("o_totalprice").alias("price"))
    first = rows(o.where("o_custkey % 3 > 0"), "first")
    return records.union_by_key(first.unionByName(first), rows(o.where("o_orderstatus = 'F'"), "second"))
