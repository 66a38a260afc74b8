"""Queries of record-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import records
from lectern.queries import query, table


@query("SELECT o_orderkey AS key, o_orderstatus AS status, s.ord FROM orders JOIN (SELECT c_custkey * 7 AS key, min(c_custkey) AS ord FROM customer GROUP BY 1) s ON s.key = o_orderkey")
def items_by_key(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit(" "), (F.col("c_custkey") * 7).cast("string")).alias("key"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"))
    return records.lookup(items, keys).select(F.col("key").cast("long").alias("key"), "status", "ord")


@query(
    """SELECT o_orderkey AS key, coalesce(c, '') AS children FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def items_with_children(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey")
    t = records.with_children(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), children, "pos")
    return t.select("key", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["pos"], c["l_partkey"], c["l_suppkey"])), ",").alias("children"))


@query(
    """WITH e AS (SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, CASE WHEN turn % 3 > 0 THEN turn % 3 END AS page FROM conversations),
l AS (SELECT conv_id, turn, page, '<p><a href="library://x/' || turn || '">' || CASE WHEN turn % 2 = 0 THEN 'page ' || turn ELSE 'no page' END || ' - highlight</a>' || CASE WHEN t <> '' THEN ' "' || t || '"' ELSE '' END || CASE WHEN turn % 5 = 0 THEN ' Comment: c&amp;d' ELSE '' END || '</p>' AS x FROM e)
SELECT conv_id AS parent, CAST(count(*) AS INTEGER) AS n, '<h1>Annotations (' || count(*) || ')</h1>' || string_agg(x, '' ORDER BY page IS NULL, coalesce(page, 0), turn) AS note FROM l GROUP BY 1"""
)
def annotation_notes(spark, sf_dir):
    t = F.col("turn")
    position = F.when(t % 3 > 0, F.concat(F.lit('{"pageIndex":'), (t % 3).cast("string"), F.lit(',"rects":[[0,0,1,1]]}'))).otherwise('{"pageIndex":"x"}')
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("parent"), t.alias("pos"), F.lit("highlight").alias("type"), records.annotation_page(position).alias("page"), F.when(t % 2 == 0, t.cast("string")).alias("label"), "text",
        F.when(t % 5 == 0, "c&d").alias("comment"), F.concat(F.lit("library://x/"), t.cast("string")).alias("link"),
    )
    return records.annotation_notes(rows)


@query("SELECT o_orderkey AS batch, CAST(o_orderkey % 3 AS INTEGER) AS idx, CASE WHEN o_custkey % 4 > 0 THEN 'K' || o_custkey END AS key, CASE WHEN o_custkey % 4 = 0 THEN 'HTTP 412' END AS error FROM orders")
def batch_results(spark, sf_dir):
    idx, c = (F.col("o_orderkey") % 3).cast("string"), F.col("o_custkey")
    ok = F.concat(F.lit('{"successful":{"'), idx, F.lit('":{"key":"K'), c.cast("string"), F.lit('","version":3}},"failed":{}}'))
    lost = F.concat(F.lit('{"successful":{},"failed":{"'), idx, F.lit('":{"code":412,"message":"changed"}}}'))
    return records.batch_results(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), F.when(c % 4 > 0, ok).otherwise(lost).alias("body")))


@query(
    """SELECT c_custkey AS key, coalesce(max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY, false) AS cached FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"""
)
def cached_answers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return records.fresh(requests, events.select(F.col("user_id").alias("key"), F.col("ts").alias("cached_at")), now, 2 * 86400).select("key", "cached")


@query(
    """WITH o AS (SELECT user_id AS plan, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'create' ELSE 'patch' END AS kind, 'K' || event_id AS key, CASE WHEN event_id % 3 = 0 THEN '@created:' || event_id % 40 ELSE 'v' END AS value FROM events),
m AS (SELECT plan, '@created:' || (row_number() OVER (PARTITION BY plan ORDER BY seq) - 1) AS ref, key AS made FROM o WHERE kind = 'create')
SELECT o.plan, seq, kind, key, CASE WHEN value LIKE '@created:%' THEN made ELSE value END AS value FROM o LEFT JOIN m ON m.plan = o.plan AND m.ref = o.value"""
)
def created_references(spark, sf_dir):
    e = F.col("event_id")
    ops = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("plan"), e.alias("seq"), F.when(F.col("event_type").isin("click", "view"), "create").otherwise("patch").alias("kind"), F.concat(F.lit("K"), e.cast("string")).alias("key"),
        F.when(e % 3 == 0, F.concat(F.lit("@created:"), (e % 40).cast("string"))).otherwise("v").alias("value"),
    )
    return records.resolve_created(ops)


@query(
    """SELECT c_custkey AS key, CAST(0 AS INTEGER) AS step, CASE WHEN c_nationkey < 5 THEN 'delete' ELSE 'trash' END AS kind FROM customer UNION ALL SELECT c_custkey, 1, 'delete' FROM customer WHERE c_nationkey >= 5"""
)
def deletion_plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey"))
    return records.deletions(c, F.col("c_nationkey") < 5, permanent=True)


@query(
    """WITH p AS (SELECT conv_id AS file, turn, role || turn % 4 AS name FROM conversations WHERE turn % 2 = 0), h AS (SELECT file, name, count(*) AS n FROM p GROUP BY 1, 2),
k AS (SELECT DISTINCT conv_id AS file, role || turn % 4 AS name FROM conversations WHERE turn % 3 > 0)
SELECT coalesce(h.file, k.file) AS file, coalesce(h.name, k.name) AS name, coalesce(n, 0) AS hits, CASE WHEN k.name IS NULL THEN 'unmapped' WHEN n IS NULL THEN 'unused' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS state
FROM h FULL JOIN k ON h.file = k.file AND h.name = k.name"""
)
def placeholder_report(spark, sf_dir):
    """Conversations read as documents: even turns are paragraphs that cite, split over two runs."""
    t, name = F.col("turn"), F.concat("role", (F.col("turn") % 4).cast("string"))
    c = table(spark, sf_dir, "conversations")
    p = F.when(t % 2 == 0, F.concat(F.lit("<w:p><w:r><w:t>see {{ci</w:t></w:r><w:r><w:t xml:space='preserve'>te:"), name, F.lit("}} &amp; on</w:t></w:r></w:p>"))).otherwise("<w:p/>")
    xml = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", p.alias("p")))), lambda s: s["p"]), "")
    documents = c.groupBy(F.col("conv_id").alias("file")).agg(xml.alias("xml"))
    mapping = c.where("turn % 3 > 0").select(F.col("conv_id").alias("file"), name.alias("name"))
    return records.placeholder_report(records.placeholders(records.paragraphs(documents)), mapping)
