"""Queries of citation exports and bibliography audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import assembly, exchange, exports
from lectern.queries import query, table

_BIB = "'@article{k' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {' || p_brand || '},' || chr(10) || '  year = {' || CASE WHEN p_size < 40 THEN CAST(p_size + 1970 AS VARCHAR) ELSE '' END || '}' || chr(10) || '}'"


@query(
    f"""SELECT p_partkey AS key, {_BIB} AS bib, 'TY  - JOUR' || chr(10) || 'TI  - ' || p_name || chr(10) || 'PY  - ' || CASE WHEN p_size < 40 THEN CAST(p_size + 1970 AS VARCHAR) ELSE '' END || chr(10) || 'ER  -' AS ris,
  '{{"id":"k' || p_partkey || '","type":"' || CASE WHEN p_type = 'PROMO' THEN 'book' ELSE 'article-journal' END || '","title":"' || p_name || '","DOI":' || CASE WHEN p_partkey % 2 = 0 THEN '"10.1000/' || p_partkey || '"' ELSE 'null' END || '}}' AS csl FROM part"""
)
def rendered_citations(spark, sf_dir):
    k = F.col("p_partkey")
    key, year = F.concat(F.lit("k"), k.cast("string")), F.when(F.col("p_size") < 40, (F.col("p_size") + 1970).cast("string"))
    kind = F.when(F.col("p_type") == "PROMO", "book").otherwise("journalArticle")
    return table(spark, sf_dir, "part").select(
        k.alias("key"), exports.bibtex(key, F.col("p_name"), F.col("p_brand"), year).alias("bib"), exports.ris(F.col("p_name"), year).alias("ris"),
        exports.csl_json(key, kind, F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit("10.1000/"), k.cast("string")))).alias("csl"),
    )


def _files(spark, sf_dir):
    """One bibliography per brand; some entries lack a year line, some a brace."""
    k = F.col("p_partkey")
    entry = F.concat(
        F.lit("@article{k"), k.cast("string"), F.lit(",\n  title = {"), F.col("p_name"), F.lit("},\n  author = {"), F.col("p_type"), F.lit("}"), F.when(k % 3 > 0, F.lit(",\n  Year = {2000}")).otherwise(""), F.when(k % 8 > 0, F.lit("\n}")).otherwise("\n")
    )
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda s: s["e"]), "\n\n")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("file")).agg(ordered.alias("content"))


@query(
    """SELECT p_brand AS file, count(*) AS n_entries, count(*) AS n_keys, CAST(sum((p_partkey % 8 = 0)::INT + (p_partkey % 3 = 0)::INT) AS BIGINT) AS n_problems, count(*) FILTER (WHERE p_partkey % 3 = 0) AS n_undated,
  sum((p_partkey % 8 = 0)::INT + (p_partkey % 3 = 0)::INT) = 0 AS ok FROM part GROUP BY 1"""
)
def bibliography_audit(spark, sf_dir):
    return exports.file_report(exports.audit(_files(spark, sf_dir)))


@query("SELECT p_brand AS file, CAST(count(*) AS INTEGER) AS n_entries FROM part GROUP BY 1")
def bibliography_counts(spark, sf_dir):
    return _files(spark, sf_dir).select("file", exports.count_entries(F.col("content")).alias("n_entries"))


@query(
    """WITH k AS (SELECT p_partkey AS k, (p_partkey * 7919) % 100003 AS ord FROM part WHERE p_partkey % 3 > 0
), e AS (SELECT ord, k, 0 AS pos, '{"id":"k' || k || '"}' AS x FROM k UNION ALL SELECT ord, k, 1, '{"id":"k' || k || 'b","n":[1,2]}' FROM k WHERE k % 2 = 0
), n AS (SELECT *, row_number() OVER (ORDER BY ord, k, pos) - 1 AS number, count(*) OVER () AS total FROM e)
SELECT number, CASE WHEN number = 0 THEN '[' || chr(10) ELSE '' END || '  ' || x || CASE WHEN number = total - 1 THEN chr(10) || ']' ELSE ',' END AS text FROM n"""
)
def merged_json(spark, sf_dir):
    """Answers of parts, arrays or single objects, merged into one array in the order of the request."""
    k = F.col("p_partkey")
    p, s = table(spark, sf_dir, "part"), k.cast("string")
    one = F.concat(F.lit('{"id":"k'), s, F.lit('"}'))
    body = F.when(k % 2 == 0, F.concat(F.lit("["), one, F.lit(', {"id":"k'), s, F.lit('b","n":[1,2]}]'))).otherwise(one)
    place = lambda n: F.struct(n.alias("place"), k.alias("number")).alias("ord")  # noqa: E731  places come again from part 100003 on; parts at one place go by number
    at, named = (k * 7919) % 100003, F.concat(F.lit(" "), s).alias("key")
    asked = p.where(k % 3 > 0)
    keys = asked.select(place(at), named).unionByName(asked.select(place(at + 200000), named)).unionByName(p.select(place(k), F.lit(" ").alias("key")))
    return assembly.merged(keys, p.select(s.alias("key"), body.alias("body")), "csljson").select("number", "text")


@query(
    """WITH k AS (SELECT p_partkey AS k, p_name FROM part WHERE p_partkey % 5 > 0), n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS number, count(*) OVER () AS total FROM k)
SELECT number, p_name || ' of ' || k || CASE WHEN number = total - 1 THEN '' ELSE chr(10) END AS text FROM n"""
)
def merged_text(spark, sf_dir):
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    body = F.when(k % 5 == 0, " \n ").otherwise(F.concat(F.lit("\n "), "p_name", F.lit(" of "), k.cast("string"), F.lit(" \n")))
    return assembly.merged(p.select(k.alias("ord"), k.cast("string").alias("key")), p.select(k.cast("string").alias("key"), body.alias("body")), "bibtex").select("number", "text")


@query(
    """WITH i AS (SELECT p_partkey AS key, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'small' ELSE 'large' END AS export, 'n' || p_partkey AS path FROM part WHERE p_partkey % 4 > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY export ORDER BY key) AS n FROM i
), a AS (SELECT export, key, n, l_linestatus, row_number() OVER (PARTITION BY export ORDER BY key, l_orderkey * 10 + l_linenumber) AS m, l_linenumber FROM r JOIN lineitem ON l_partkey = key WHERE l_returnflag = 'A')
SELECT export, 0 AS section, n - 1 AS k, '    <Reference id="x-R' || n || '" ReferenceType="Book">' || chr(10) || '      <Title>' || p_name || '</Title>' || chr(10) || '      <Year>1999</Year>' || chr(10) || '      <DOI></DOI>' || chr(10) || '    </Reference>' AS xml FROM r
UNION ALL SELECT export, 1, n - 1, '    <Location id="x-L' || n || '">' || chr(10) || '      <ReferenceID>x-R' || n || '</ReferenceID>' || chr(10) || '      <Address>{&quot;UriString&quot;:&quot;' || path || '&quot;}</Address>' || chr(10) || '    </Location>' FROM r
UNION ALL SELECT export, 2, m - 1, '    <KnowledgeItem id="x-K' || m || '">' || chr(10) || '      <CoreStatement></CoreStatement>' || chr(10) || '      <Text>' || l_linestatus || '</Text>' || chr(10) || '      <QuotationType>5</QuotationType>' || chr(10) || '      <PageRange>' || l_linenumber || '</PageRange>' || chr(10) || '    </KnowledgeItem>' FROM a
UNION ALL SELECT export, 3, m - 1, '    <Annotation id="x-A' || m || '">' || chr(10) || '      <Quads>[{&quot;PageIndex&quot;:' || (l_linenumber + 1) || ',&quot;IsContainer&quot;:false,&quot;X1&quot;:1,&quot;Y1&quot;:2,&quot;X2&quot;:3,&quot;Y2&quot;:4}]</Quads>' || chr(10) || '      <LocationID>x-L' || n || '</LocationID>' || chr(10) || '    </Annotation>' FROM a
UNION ALL SELECT export, 4, m - 1, '    <EntityLink>' || chr(10) || '      <SourceID>x-K' || m || '</SourceID>' || chr(10) || '      <TargetID>x-A' || m || '</TargetID>' || chr(10) || '    </EntityLink>' FROM a"""
)
def exchange_elements(spark, sf_dir):
    """Parts and their order lines as references and annotations of two exports, numbered in each."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, "small").otherwise("large").alias("export"), k.alias("ord"), k.alias("key"), F.col("p_name").alias("title"), F.lit("1999").alias("year"), F.lit(None).cast("string").alias("doi"),
        F.when(k % 4 > 0, F.concat(F.lit("n"), k.cast("string"))).alias("path"), F.lit("Book").alias("reference_type"),
    )
    number = F.col("l_linenumber").cast("string")
    position = F.when(F.col("l_returnflag") == "A", F.concat(F.lit('{"pageIndex":'), number, F.lit(',"rects":[[1,2,3,4]]}'))).otherwise("{}")
    none = F.lit(None).cast("string")
    notes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit("highlight").alias("type"), F.col("l_linestatus").alias("text"), none.alias("comment"), F.lit("#ffd401").alias("color"), number.alias("label"), position.alias("position"),
    )
    return exchange.elements(items, notes)
