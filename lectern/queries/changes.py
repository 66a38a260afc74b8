"""Queries of change plans: diffs, application, rollback, tags, annotations, attachments, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import changes
from lectern.queries import query, table

#: Orders in long form, and the values a plan wants them to have.
_LONG = """before AS (
  SELECT o_orderkey AS key, o_custkey % 5 AS version, f AS field, CASE f WHEN 'status' THEN o_orderstatus WHEN 'priority' THEN o_orderpriority ELSE CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS VARCHAR) END END AS value
  FROM orders, (SELECT unnest(['status', 'priority', 'customer']) AS f)
), wanted AS (
  SELECT key, version, field, CASE field WHEN 'status' THEN 'F' WHEN 'priority' THEN value ELSE CASE WHEN key % 3 = 0 THEN value ELSE 'c' || key END END AS value FROM before
)"""


def _long(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "customer": F.when(k % 4 > 0, c.cast("string"))}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in value.items()])
    before = table(spark, sf_dir, "orders").select(k.alias("key"), (c % 5).alias("version"), F.explode(cells).alias("f")).select("key", "version", "f.*")
    new = F.when(F.col("field") == "status", "F").when(F.col("field") == "priority", F.col("value")).otherwise(F.when(F.col("key") % 3 == 0, F.col("value")).otherwise(F.concat(F.lit("c"), F.col("key").cast("string"))))
    return before, before.withColumn("value", new)


@query(f"WITH {_LONG} SELECT b.key, b.field, b.value AS before, w.value AS after, coalesce(b.value, '') <> '' AS destructive FROM before b JOIN wanted w USING (key, field) WHERE b.value IS DISTINCT FROM w.value")
def field_diff(spark, sf_dir):
    return changes.diff(*_long(spark, sf_dir))


@query("SELECT user_id AS key, event_type AS field, CAST(value AS VARCHAR) IS NOT NULL AS has_value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_write_wins(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), F.col("value").isNotNull().alias("has_value"))
    return changes.last_per_field(ops)


def _operations(spark, sf_dir):
    before, wanted = _long(spark, sf_dir)
    d = changes.diff(before, wanted).join(before.select("key", "version").distinct(), "key")
    ops = d.select("key", "field", F.col("after").alias("value"), F.lit(1).alias("seq"), F.when(F.col("key") % 10 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("expected_version"))
    return before, ops


@query(
    f"""WITH {_LONG}, ops AS (SELECT w.* FROM before b JOIN wanted w USING (key, field) WHERE b.value IS DISTINCT FROM w.value AND key % 10 <> 0), t AS (SELECT DISTINCT key FROM ops),
r AS (SELECT b.key, b.version + CASE WHEN t.key IS NULL THEN 0 ELSE 1 END AS version, b.field, CASE WHEN o.key IS NULL THEN b.value ELSE o.value END AS value FROM before b LEFT JOIN ops o USING (key, field) LEFT JOIN t ON t.key = b.key)
SELECT * FROM r WHERE value IS NOT NULL"""
)
def applied_plan(spark, sf_dir):
    """Every tenth order has moved on since the plan was made: its operations are conflicts."""
    return changes.apply(*_operations(spark, sf_dir))


@query(f"WITH {_LONG} SELECT key, count(*) AS n FROM before b JOIN wanted w USING (key, field) WHERE b.value IS DISTINCT FROM w.value AND key % 10 = 0 GROUP BY 1")
def plan_conflicts(spark, sf_dir):
    return changes.conflicts(*_operations(spark, sf_dir)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LONG}, d AS (SELECT b.key, b.field, b.value AS old, w.value AS now FROM before b JOIN wanted w USING (key, field))
SELECT key, 'restore' AS action, field, coalesce(old, '') AS value FROM d WHERE old IS DISTINCT FROM now
UNION ALL SELECT c_custkey + 100000000, 'already-gone', NULL, NULL FROM customer UNION ALL SELECT DISTINCT key, 'remove', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM before"""
)
def rollback_plan(spark, sf_dir):
    before, wanted = _long(spark, sf_dir)
    created = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 100000000).alias("key")).unionByName(before.select("key").distinct())
    return changes.rollback(before, wanted, created)


@query(
    """WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter(t, lambda x: x <> 'click'), ',') AS removed, array_to_string(CASE WHEN list_contains(t, 'zz') THEN t ELSE list_append(t, 'zz') END, ',') AS added,
  array_to_string(CASE WHEN list_contains(t, 'error') AND list_contains(t, 'click') THEN list_filter(t, lambda x: x <> 'error') ELSE list_transform(t, lambda x: CASE WHEN x = 'error' THEN 'click' ELSE x END) END, ',') AS renamed FROM g"""
)
def tag_changes(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    t = F.col("t")
    return g.select(
        "user_id", F.array_join(changes.remove_tags(t, F.array(F.lit("click"))), ",").alias("removed"), F.array_join(changes.add_tags(t, F.array(F.lit("zz"))), ",").alias("added"),
        F.array_join(changes.rename_tag(t, "error", "click"), ",").alias("renamed"),
    )


_NOTES = "SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 2 = 0 THEN 'highlight' ELSE 'note' END AS type, CAST(turn AS VARCHAR) AS position, text, CASE WHEN turn % 3 > 0 THEN role END AS comment FROM conversations"


@query(f"WITH n AS ({_NOTES}) SELECT key, type FROM n WHERE type <> 'highlight' OR comment IS NOT NULL")
def annotation_idempotent(spark, sf_dir):
    """Highlights without a comment are in the library already."""
    t = F.col("turn")
    n = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + t).alias("key"), F.when(t % 2 == 0, "highlight").otherwise("note").alias("type"), t.cast("string").alias("position"), "text", F.when(t % 3 > 0, F.col("role")).alias("comment")
    )
    return changes.new_annotations(n, n.where("type = 'highlight' and comment is null")).select("key", "type")


@query(
    """WITH s AS (SELECT conv_id * 1000 + turn AS key, role AS t, turn % 3 AS page, 'p' || turn AS label, row_number() OVER (PARTITION BY role, turn % 3 ORDER BY conv_id * 1000 + turn) AS k FROM conversations WHERE turn > 0),
g AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'user' ELSE 'assistant' END AS t, l_suppkey % 3 AS page, CASE WHEN l_partkey % 2 = 0 THEN 'p1' END AS label,
  row_number() OVER (PARTITION BY l_linenumber % 2, l_suppkey % 3 ORDER BY ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) AS k FROM lineitem)
SELECT s.key AS source_key, g.key AS target_key, g.label AS before, s.label AS after FROM s JOIN g USING (t, page, k) WHERE s.label IS DISTINCT FROM g.label"""
)
def label_backfill(spark, sf_dir):
    t = F.col("turn")
    s = table(spark, sf_dir, "conversations").where("turn > 0").select((F.col("conv_id") * 1000 + t).alias("key"), F.col("role").alias("text"), (t % 3).alias("page"), F.concat(F.lit("p"), t.cast("string")).alias("label"))
    ln = F.col("l_linenumber")
    g = table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 10 + ln) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("key"), F.when(ln % 2 == 0, " user ").otherwise("assistant").alias("text"), (F.col("l_suppkey") % 3).alias("page"), F.when(F.col("l_partkey") % 2 == 0, "p1").alias("label")
    )
    return changes.label_backfill(s, g)


@query("SELECT p_partkey AS parent, 'C:/Lib/' || p_name || '.pdf' AS path FROM part WHERE p_size >= 25")
def attachments_to_create(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = p.select(F.col("p_partkey").alias("parent"), F.concat(F.lit("C:/Lib/"), "p_name", F.lit(".pdf")).alias("path"))
    return changes.attachments_to_create(wanted, p.where("p_size < 25").select(F.col("p_partkey").alias("parent"), F.upper(F.concat(F.lit("c:\\lib\\"), "p_name", F.lit(".pdf"))).alias("path")))


@query(
    """SELECT s_nationkey AS group_id, min(s_suppkey) AS primary_key, count(*) AS n_members, CAST(sum(n) AS BIGINT) AS children, string_agg(DISTINCT 'T' || s_suppkey % 4, ',' ORDER BY 'T' || s_suppkey % 4) AS tags
FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey) GROUP BY 1"""
)
def merge_impacts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("key")).join(n, "key")
    first = s.groupBy("group_id").agg(F.min("key").alias("first"))
    rows = s.join(first, "group_id").withColumn("is_primary", F.col("key") == F.col("first")).withColumn("tags", F.array(F.concat(F.lit("T"), (F.col("key") % 4).cast("string")))).withColumn("collections", F.col("tags"))
    return changes.merge_impacts(rows).select("group_id", "primary_key", "n_members", "children", F.array_join("tags", ",").alias("tags"))


@query("SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS old_parent, CASE WHEN l_partkey IN (SELECT p_partkey FROM part) THEN l_partkey - l_partkey % 3 ELSE l_partkey END AS parent FROM lineitem")
def reparented_children(spark, sf_dir):
    p = F.col("p_partkey")
    members = table(spark, sf_dir, "part").select(p.alias("key"), (p - p % 3).alias("primary_key"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("old_parent"), F.col("l_partkey").alias("parent"))
    return changes.reparent(children, members)
