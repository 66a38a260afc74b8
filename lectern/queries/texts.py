"""Queries of the text and identifier functions, over texts of the tables or forms made from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import identifiers as ids
from lectern.functions import text as tx
from lectern.queries import query, table


def _of(name):
    """Input made by one expression that both engines read alike."""
    return lambda spark, sf_dir: table(spark, sf_dir, name)


@query(
    """WITH t AS (SELECT o_orderkey AS key, CASE o_orderkey % 5 WHEN 0 THEN ' https://doi.org/10.1000/Ab' WHEN 1 THEN 'DOI: 10.1000/Ab' WHEN 2 THEN 'http://dx.doi.org/10.1000/Ab' WHEN 3 THEN '10.1000/Ab' ELSE '' END
  || CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN '.,' ELSE '' END END AS raw FROM orders)
SELECT key, nullif(lower(trim(regexp_replace(regexp_replace(trim(raw), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:\\s*', '', 'i'))), '') AS doi_key,
  nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:\\s*', '', 'i'), '[.,;]+$', '')), '') AS doi_reference,
  nullif(regexp_replace(raw, '[^0-9]', '', 'g'), '') AS pmid_key, nullif(upper(regexp_replace(raw, '[^0-9Xx]', '', 'g')), '') AS isbn_key FROM t"""
)
def doi_forms(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    prefix = F.when(k == 0, " https://doi.org/10.1000/Ab").when(k == 1, "DOI: 10.1000/Ab").when(k == 2, "http://dx.doi.org/10.1000/Ab").when(k == 3, "10.1000/Ab").otherwise("")
    rest = F.when(k == 4, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".,").otherwise("")))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(prefix, rest).alias("raw"))
    return t.select("key", *[f(F.col("raw")).alias(f.__name__) for f in (ids.doi_key, ids.doi_reference, ids.pmid_key, ids.isbn_key)])


@query(
    """WITH t AS (SELECT c_custkey AS key, CASE c_custkey % 8 WHEN 0 THEN 'PMID: ' || c_custkey WHEN 1 THEN 'isbn 978-0-306-40615-' || (c_custkey % 10) WHEN 2 THEN 'https://doi.org/10.1000/' || c_custkey
  WHEN 3 THEN '10.1234/x' || c_custkey WHEN 4 THEN CAST(c_custkey AS VARCHAR) WHEN 5 THEN '030640615X' WHEN 6 THEN '9780306406' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') ELSE c_name END AS raw FROM customer),
k AS (SELECT key, raw, CASE WHEN regexp_matches(lower(raw), '^pmid[: ]') THEN 'pmid' WHEN regexp_matches(lower(raw), '^isbn[: ]') THEN 'isbn' WHEN lower(raw) LIKE 'doi:%' OR lower(raw) LIKE '%doi.org/%' THEN 'doi'
  WHEN regexp_matches(raw, '^10\\.\\d{4,9}/\\S+$') THEN 'doi' WHEN regexp_matches(raw, '^\\d{1,8}$') THEN 'pmid' WHEN regexp_matches(regexp_replace(raw, '[-\\s]', '', 'g'), '^(\\d{9}[\\dxX]|\\d{13})$') THEN 'isbn' END AS kind FROM t)
SELECT key, kind, CASE kind WHEN 'doi' THEN trim(regexp_replace(regexp_replace(raw, '^doi:\\s*', '', 'i'), '^https?://(dx\\.)?doi\\.org/', '', 'i'))
  WHEN 'isbn' THEN regexp_replace(regexp_replace(raw, '^isbn[:\\s]*', '', 'i'), '[-\\s]', '', 'g') WHEN 'pmid' THEN trim(regexp_replace(raw, '^pmid[:\\s]*', '', 'i')) END AS value FROM k"""
)
def identifier_kinds(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("c_custkey") % 8
    s = c.cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("PMID: "), s)).when(k == 1, F.concat(F.lit("isbn 978-0-306-40615-"), (c % 10).cast("string"))).when(k == 2, F.concat(F.lit("https://doi.org/10.1000/"), s))
        .when(k == 3, F.concat(F.lit("10.1234/x"), s)).when(k == 4, s).when(k == 5, "030640615X").when(k == 6, F.concat(F.lit("9780306406"), F.lpad((c % 1000).cast("string"), 3, "0"))).otherwise(F.col("c_name"))
    )
    t = table(spark, sf_dir, "customer").select(c.alias("key"), raw.alias("raw"))
    return t.select("key", ids.identifier_kind(F.col("raw")).alias("kind"), ids.identifier_value(F.col("raw")).alias("value"))


@query(
    """WITH t AS (SELECT doc_id AS key, text || CASE doc_id % 4 WHEN 0 THEN ' see 10.1000/abc' || doc_id || '. And' WHEN 1 THEN ' arXiv: 2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v2 x'
  WHEN 2 THEN ' ISBN-13: 978-0-306-40615-7 y' ELSE '' END AS text FROM documents),
v AS (SELECT key, nullif(regexp_replace(regexp_extract(text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), '[.,;:]+$', ''), '') AS doi, nullif(regexp_extract(text, 'arXiv:\\s*(\\d{4}\\.\\d{4,5})(?:v\\d+)?', 1, 'i'), '') AS arxiv,
  regexp_replace(regexp_extract(text, '\\bISBN(?:-1[03])?:?\\s*((?:97[89][-\\s]?)?\\d[-\\d\\s]{9,16}[\\dXx])\\b', 1), '[^0-9Xx]', '', 'g') AS isbn FROM t)
SELECT key, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN length(isbn) >= 10 THEN 'isbn' END AS kind, coalesce(doi, arxiv, CASE WHEN length(isbn) >= 10 THEN isbn END) AS value FROM v"""
)
def identifiers_in_text(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("doc_id") % 4
    s = d.cast("string")
    tail = (
        F.when(k == 0, F.concat(F.lit(" see 10.1000/abc"), s, F.lit(". And"))).when(k == 1, F.concat(F.lit(" arXiv: 2101."), F.lpad((d % 100000).cast("string"), 5, "0"), F.lit("v2 x")))
        .when(k == 2, " ISBN-13: 978-0-306-40615-7 y").otherwise("")
    )
    t = table(spark, sf_dir, "documents").select(d.alias("key"), ids.found_identifier(F.concat("text", tail)).alias("f"))
    return t.select("key", "f.kind", "f.value")


@query(
    """SELECT o_orderkey AS key, nullif(regexp_extract(regexp_replace(raw, '^PMC', ' ', 'i'), '(\\d{3,9})', 1), '') AS pmc,
  'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || nullif(regexp_extract(regexp_replace(raw, '^PMC', ' ', 'i'), '(\\d{3,9})', 1), '') || '/' AS address
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'PMC' ELSE 'pmc-' END || CAST(o_custkey AS VARCHAR) AS raw FROM orders)"""
)
def pmc_ids(spark, sf_dir):
    raw = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "PMC").otherwise("pmc-"), F.col("o_custkey").cast("string"))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), ids.pmc_id(raw).alias("pmc"))
    return t.select("key", "pmc", ids.pmc_address(F.col("pmc")).alias("address"))


@query(
    """SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM (
  SELECT page_id, html, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&')) AS t FROM pages)"""
)
def html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html", tx.plain_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query(
    """WITH t AS (SELECT page_id, html AS h FROM pages)
SELECT page_id, replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html_text, replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml_text,
  CASE WHEN page_id % 2 = 0 THEN trim(h) ELSE '<p>' || replace(replace(replace(replace(trim(replace(h, '<', '(')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</p>' END AS note,
  trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS abstract FROM t"""
)
def escaping(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("h"))
    note = F.when(F.col("page_id") % 2 == 0, F.col("h")).otherwise(F.replace("h", F.lit("<"), F.lit("(")))
    return t.select("page_id", tx.escape_html(F.col("h")).alias("html_text"), tx.escape_xml(F.col("h")).alias("xml_text"), tx.note_html(note).alias("note"), tx.strip_markup(F.col("h")).alias("abstract"))


@query(
    """WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, l_shipdate AS d FROM lineitem)
SELECT o, n, k, CASE k % 3 WHEN 0 THEN strftime(d, '%Y') WHEN 1 THEN strftime(d, '%Y-%m-%d') END AS pdf_date, CAST(year(d) AS VARCHAR) || '-' || lpad(CAST(month(d) AS VARCHAR), 2, '0') || CASE WHEN k % 2 = 0 THEN '-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') ELSE '' END AS from_parts,
  CAST(CASE WHEN k % 3 < 2 THEN year(d) END AS INTEGER) AS year FROM t"""
)
def dates(spark, sf_dir):
    d, k = F.col("l_shipdate"), F.col("l_partkey")
    raw = F.when(k % 3 == 0, F.date_format(d, "yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).otherwise("Spring")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), k.alias("k"), tx.pdf_date(raw).alias("pdf_date"),
        tx.date_from_parts(F.year(d), F.month(d), F.when(k % 2 == 0, F.dayofmonth(d))).alias("from_parts"), tx.first_year(raw).alias("year"),
    )


@query(
    """WITH t AS (SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN 'Smith' || s_suppkey || ', Anna B.' WHEN 1 THEN 'Anna B. Smith' || s_suppkey ELSE 'Plato' END AS raw FROM supplier)
SELECT key, CASE WHEN contains(raw, ',') THEN trim(split_part(raw, ',', 1)) ELSE list_last(string_split(raw, ' ')) END AS last,
  CASE WHEN contains(raw, ',') THEN trim(split_part(raw, ',', 2)) WHEN contains(raw, ' ') THEN array_to_string(string_split(raw, ' ')[:-2], ' ') END AS first,
  regexp_replace(lower(CASE WHEN contains(raw, ',') THEN trim(split_part(raw, ',', 1)) ELSE list_last(string_split(raw, ' ')) END), '[^a-z0-9]', '', 'g') AS surname FROM t"""
)
def creator_names(spark, sf_dir):
    k, s = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Smith"), s, F.lit(", Anna B."))).when(k == 1, F.concat(F.lit("Anna B. Smith"), s)).otherwise("Plato")
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), tx.name_parts(raw).alias("p"))
    return t.select("key", "p.last", "p.first", tx.surname(F.col("p.last"), F.lit(None).cast("string")).alias("surname"))


@query(
    """WITH t AS (SELECT p_partkey AS key, 'C:\\lib\\' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.html' WHEN 2 THEN '.docx' ELSE '' END AS path, replace(p_name, ' ', '__') || '-2020.pdf' AS file FROM part)
SELECT key, replace(path, '\\', '/') AS posix, CASE key % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS type,
  trim(regexp_replace(regexp_replace(regexp_replace(file, '\\.pdf$', '', 'i'), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
  'D:/a b/' || p AS opened, key % 2 = 0 AS loopback FROM (SELECT t.*, CAST(key AS VARCHAR) || '+x' AS p FROM t)"""
)
def paths(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    path = F.concat(F.lit("C:\\lib\\"), name, F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".html").when(k % 4 == 2, ".docx").otherwise(""))
    url = F.concat(F.lit("file:///D:/a%20b/"), k.cast("string"), F.lit("+x"))
    return table(spark, sf_dir, "part").select(
        k.alias("key"), tx.posix_path(path).alias("posix"), tx.content_type(tx.posix_path(path)).alias("type"), tx.title_from_file_name(F.concat(F.replace(name, F.lit(" "), F.lit("__")), F.lit("-2020.pdf"))).alias("title"),
        tx.file_path(url).alias("opened"), tx.is_loopback(F.when(k % 2 == 0, "http://localhost:23119/api").otherwise("http://example.org/localhost")).alias("loopback"),
    )


@query(
    """SELECT doc_id, length(t) >= 6 AND NOT regexp_matches(t, '^[\\d\\W_]+$') AND (regexp_matches(t, '\\s') OR length(t) >= 12) AS usable, length(t) >= 6 AND regexp_matches(t, '\\s') AS lookup, t AS squeezed
FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS t FROM documents)"""
)
def usable_titles(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.squeeze(F.element_at(F.split("text", "\n"), 1)).alias("squeezed"))
    return t.select("doc_id", tx.usable_title(F.col("squeezed")).alias("usable"), tx.title_for_lookup(F.col("squeezed")).alias("lookup"), "squeezed")


@query(
    """SELECT event_id, 'library://open-pdf/library/items/A' || user_id || '?' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'page=' || (event_id % 50) || '&' END || 'annotation=E' || event_id AS link,
  CASE WHEN event_id % 3 = 0 THEN 'library://select/library/items/E' || event_id ELSE 'library://open-pdf/groups/7/items/E' || event_id || '?page=' || (event_id % 50 + 1) || '&annotation=K' || user_id END AS reveal,
  lpad(CAST(event_id % 50 AS VARCHAR), 5, '0') || '|000000|' || lpad(substr(CAST(CAST(greatest(0, floor(value * 1000)) AS BIGINT) AS VARCHAR), 1, 5), 5, '0') AS sort_index,
  CASE WHEN user_id < 10 THEN '(set, length 7)' ELSE substr('secret-' || user_id, 1, 4) || '... (length ' || length('secret-' || user_id) || ')' END AS masked FROM events"""
)
def links_and_keys(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    page = F.when(e % 3 == 0, F.lit(None)).otherwise((e % 50).cast("string"))
    whole = lambda *c: F.concat(*c)
    plain = tx.reveal_link("library", whole(F.lit("E"), e.cast("string")), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    opened = tx.reveal_link("library", whole(F.lit("E"), e.cast("string")), (e % 50 + 1), whole(F.lit("K"), u.cast("string")), F.lit("7"))
    secret = F.when(u < 10, "1234567").otherwise(whole(F.lit("secret-"), u.cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", tx.annotation_link("library", whole(F.lit("A"), u.cast("string")), whole(F.lit("E"), e.cast("string")), page).alias("link"), F.when(e % 3 == 0, plain).otherwise(opened).alias("reveal"),
        tx.sort_index(e % 50, F.col("value") * 1000).alias("sort_index"), tx.masked_key(secret).alias("masked"),
    )


_HEX = "'#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0')"
_PART = lambda c, k: f"CAST(('0x' || substr({c}, {2 + 2 * k}, 2)) AS INTEGER)"
_DISTANCE = lambda c, target: " + ".join(f"({_PART(c, k)} - {int(target[1 + 2 * k : 3 + 2 * k], 16)}) ** 2" for k in range(3))


@query(
    f"""WITH t AS (SELECT p_partkey AS key, {_HEX} AS color, p_partkey % 3 = 0 AS commented FROM part),
d AS (SELECT key, color, n, rank() OVER (PARTITION BY key ORDER BY dist, i) AS r FROM (
  {" UNION ALL ".join(f"SELECT key, color, {n} AS n, {i} AS i, {_DISTANCE('color', c)} AS dist FROM t" + (" WHERE NOT commented" if n in (5, 6) else "") for i, (n, c) in enumerate((n, tx.QUOTATION_COLORS[n]) for n in (1, 3, 4, 5, 6)))}))
SELECT key, color, n AS quotation_type FROM d WHERE r = 1"""
)
def quotation_types(spark, sf_dir):
    color = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    comment = F.when(F.col("p_partkey") % 3 == 0, "note").otherwise("")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), color.alias("color"), comment.alias("comment"))
    return t.select("key", "color", tx.quotation_type(F.col("color"), F.col("comment")).alias("quotation_type"))


@query(
    """SELECT event_type, status, class, count(*) AS n FROM (SELECT event_type, 400 + event_id % 30 AS status, CASE 400 + event_id % 30 WHEN 401 THEN 'write-unauthorized' WHEN 403 THEN 'local-api-disabled' WHEN 412 THEN 'version-conflict'
  WHEN 428 THEN 'missing-server-id' WHEN 429 THEN 'rate-limited' ELSE 'http-error' END AS class FROM events) GROUP BY ALL"""
)
def error_classes(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_type", (400 + F.col("event_id") % 30).alias("status"))
    return t.groupBy("event_type", "status", tx.error_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, sha1_hex AS cache_key, n_chars FROM (
  SELECT doc_id, text, substr(sha1('documents:' || doc_id), 1, 20) AS sha1_hex, length(text) AS n_chars FROM documents)"""
)
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("content_hash"), F.substring(F.sha1(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).cast("binary")), 1, 20).alias("cache_key"),
        F.length("text").cast("long").alias("n_chars"),
    )


@query(
    """WITH g AS (SELECT conv_id, list(CASE WHEN turn % 3 = 0 THEN '(' || role || ' ' || turn || ')' WHEN turn % 3 = 1 THEN ' ' || role ELSE '' END ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, list_transform(list_filter(list_transform(texts, lambda x: trim(x)), lambda x: x <> ''), lambda x: trim(regexp_replace(x, '^\\((.*)\\)$', '\\1'))) AS t FROM g)
SELECT conv_id, CASE WHEN len(t) = 0 THEN '' ELSE '(' || array_to_string(t, '; ') || ')' END AS citation FROM c"""
)
def joined_citations(spark, sf_dir):
    t, r = F.col("turn"), F.col("role")
    text = F.when(t % 3 == 0, F.concat(F.lit("("), r, F.lit(" "), t.cast("string"), F.lit(")"))).when(t % 3 == 1, F.concat(F.lit(" "), r)).otherwise("")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda s: s["x"]).alias("texts"))
    return g.select("conv_id", tx.joined_citations(F.col("texts")).alias("citation"))
