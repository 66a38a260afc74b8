"""Queries of plans applied to a stored library: final state, audit log and rollback."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import stats
from lectern.plans import compiled, journal
from lectern.queries import query, table
from lectern.sources.tables import catalogue
from lectern.storage import shared_dir

#: Parts as items, with one plan of several ordered operations on each; every fifth was planned on an older version.
_APPLIED = """WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey AS k, p_size AS v, p_name, p_brand, p_partkey % 5 = 0 AS stale, p_partkey % 4 AS m FROM part
), a AS (
  SELECT key, CAST(CASE WHEN stale THEN v WHEN m = 0 THEN v + 2 WHEN m = 1 THEN v + 3 WHEN m = 2 THEN v + 1 END AS BIGINT) AS version, NOT stale AND m = 2 AS deleted,
    CASE WHEN NOT stale AND m = 0 THEN p_name || ' again' ELSE p_name END AS title, CASE WHEN NOT stale AND m = 1 THEN '' WHEN NOT stale AND m = 0 THEN p_brand || ',new' ELSE p_brand END AS tags, k, stale, m
  FROM i WHERE stale OR m < 3
), c AS (SELECT 'new' || p_partkey AS key, CAST(2 AS BIGINT) AS version, false AS deleted, p_name AS title, '' AS tags FROM part WHERE p_partkey % 4 = 3)"""


def _library(spark, sf_dir) -> str:
    folder = f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/library-{uuid.uuid4().hex}"
    p, k, m = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_partkey") % 4
    key = k.cast("string")
    items = p.select(key.alias("key"), F.col("p_size").cast("long").alias("version"), F.lit(False).alias("deleted"), F.create_map(F.lit("title"), F.col("p_name")).alias("fields"), F.array("p_brand").alias("tags"), F.array().cast("array<string>").alias("collections"))
    journal.create(spark, folder, items)
    none = F.lit(None).cast("string")
    op = lambda seq, kind, field=none, value=none, on=key: F.struct(F.lit(seq).cast("long").alias("seq"), on.alias("key"), F.lit(kind).alias("kind"), field.alias("field"), value.alias("value"))
    title, brand, made = F.lit("title"), F.col("p_brand"), F.concat(F.lit("new"), key)
    steps = (
        F.when(m == 0, F.array(op(3, "add-tag", value=F.lit("new")), op(2, "set", title, F.concat("p_name", F.lit(" again"))), op(4, "add-tag", value=brand), op(1, "set", F.lit("version"), F.lit("9"))))
        .when(m == 1, F.array(op(1, "trash"), op(2, "restore"), op(3, "remove-tag", value=brand)))
        .when(m == 2, F.array(op(2, "trash"), op(1, "delete")))
        .otherwise(F.array(op(1, "trash"), op(2, "delete"), op(3, "create", value=F.lit("book"), on=made), op(4, "set", title, F.col("p_name"), on=made)))
    )
    plan = p.select(F.explode(steps).alias("s"), F.when(k % 5 == 0, -1).otherwise(F.col("p_size")).cast("long").alias("v")).select("s.*", "v")
    plan = plan.withColumn("expected_version", F.when(~F.col("key").startswith("new"), F.col("v"))).drop("v")
    journal.apply_plan(spark, folder, "plan-1", plan)
    journal.apply_plan(spark, folder, "plan-1", plan)  # a replay changes nothing
    return folder




def _shown(items):
    return items.select("key", "version", "deleted", F.col("fields")["title"].alias("title"), F.array_join("tags", ",").alias("tags"))


@query(f"{_APPLIED} SELECT key, version, deleted, title, tags FROM a UNION ALL SELECT * FROM c")
def plan_application(spark, sf_dir):
    """Items after ordered operations: fields, tags, trash, restore, deletion and creation in one plan, applied twice under one id."""
    return _shown(journal.current(spark, _library(spark, sf_dir)))


@query(
    """WITH o AS (SELECT p_partkey % 4 AS m, p_partkey % 5 = 0 AS stale FROM part), x AS (
  SELECT unnest(CASE m WHEN 0 THEN ['set', 'set', 'add-tag', 'add-tag'] WHEN 1 THEN ['trash', 'restore', 'remove-tag'] WHEN 2 THEN ['delete', 'trash'] ELSE ['trash', 'delete', 'create', 'set'] END) AS kind,
    unnest(CASE m WHEN 0 THEN ['read-only', 'applied', 'applied', 'unchanged'] WHEN 1 THEN ['applied', 'applied', 'applied'] WHEN 2 THEN ['not-in-trash', 'applied'] ELSE ['applied', 'applied', 'applied', 'applied'] END) AS outcome,
    unnest(CASE m WHEN 3 THEN [true, true, false, false] ELSE [true, true, true, true] END) AS known, stale FROM o)
SELECT 'plan-1' AS plan_id, kind, CASE WHEN stale AND known THEN 'conflict' ELSE outcome END AS outcome, count(*) AS n FROM x WHERE kind IS NOT NULL GROUP BY ALL"""
)
def plan_audit(spark, sf_dir):
    return journal.audit(spark, _library(spark, sf_dir)).groupBy("plan_id", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_size + CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 4 = 1 THEN 4 WHEN p_partkey % 4 = 2 THEN 2 ELSE 1 END AS BIGINT) AS version, false AS deleted, p_name AS title, p_brand AS tags FROM part"""
)
def plan_taken_back(spark, sf_dir):
    """The library after its plan was rolled back from the snapshot: as before, with later versions."""
    folder = _library(spark, sf_dir)
    journal.roll_back(spark, folder, "plan-1")
    return _shown(journal.current(spark, folder))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS key, s AS seq, CASE s WHEN 0 THEN 'remove-tag' ELSE 'add-tag' END AS kind, CASE s WHEN 0 THEN 'Brand#11' ELSE 'renamed' END AS value, CAST(p_size AS BIGINT) AS expected_version
FROM part, (SELECT unnest([CAST(0 AS BIGINT), 1]) AS s) WHERE p_brand = 'Brand#11' AND p_partkey % 3 = 0"""
)
def tag_rename_plan(spark, sf_dir):
    """A tag renamed on those of the asked items that hold it."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    items = p.select(k.cast("string").alias("key"), F.col("p_size").alias("version"), F.array("p_brand", "p_type").alias("tags"))
    asked = p.where(k % 3 == 0).select(k.cast("string").alias("key"))
    return compiled.rename_tag(items, "Brand#11", "renamed", asked.unionByName(asked)).select("key", "seq", "kind", "value", "expected_version")


@query(
    """WITH p AS (SELECT *, '@created:' || p_partkey AS key FROM part), o AS (
  SELECT key, CAST(0 AS BIGINT) AS seq, 'create' AS kind, NULL AS field, CASE WHEN p_partkey % 3 = 0 THEN 'document' ELSE 'book' END AS value FROM p
  UNION ALL SELECT key, 1, 'set', 'publisher', p_brand FROM p WHERE p_partkey % 2 = 0 UNION ALL SELECT key, 1 + (p_partkey % 2 = 0)::INT, 'set', 'title', p_name FROM p
  UNION ALL SELECT key, 2 + (p_partkey % 2 = 0)::INT, 'add-tag', NULL, p_type FROM p UNION ALL SELECT key, 3 + (p_partkey % 2 = 0)::INT, 'add-collection', NULL, 'C1' FROM p WHERE p_partkey % 5 = 0
) SELECT * FROM o"""
)
def added_items(spark, sf_dir):
    k = F.col("p_partkey")
    fields = F.create_map(F.lit("title"), F.col("p_name"), F.lit("version"), F.lit("7"), F.lit("publisher"), F.when(k % 2 == 0, F.col("p_brand")), F.lit("note"), F.lit(""))
    records = table(spark, sf_dir, "part").select(k.alias("ord"), F.when(k % 3 > 0, "book").alias("item_type"), fields.alias("fields"), F.array("p_type", F.lit(None)).alias("tags"), F.when(k % 5 == 0, F.array(F.lit("C1"))).alias("collections"))
    return compiled.add_items(records).drop("expected_version")


@query(
    """SELECT CAST(2 * count(*) AS BIGINT) AS items, CAST(sum(7 + (p_partkey % 2)) AS BIGINT) AS operations, (2 * count(*)) || ' create, ' || CAST(sum(5 + (p_partkey % 2)) AS BIGINT) || ' set' AS text FROM part"""
)
def import_plan_summary(spark, sf_dir):
    """Files imported as items with attachments; every other one was identified."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(k.alias("ord"), F.concat(F.lit("/scans/a study of "), k.cast("string"), F.lit(".pdf")).alias("path"), F.col("p_name").alias("title"), F.when(k % 2 == 1, "doi").alias("kind"), F.when(k % 2 == 1, F.concat(F.lit("10.1000/"), k.cast("string"))).alias("value"))
    return compiled.summary(compiled.import_files(files))


@query(
    """SELECT p_partkey AS key FROM part WHERE contains(lower(p_name), 'bolt') AND p_type <> 'PROMO' AND p_partkey % 4 = 1 AND p_partkey > 300
UNION ALL SELECT -p_partkey FROM part WHERE lower(p_brand) = 'brand#12' OR p_partkey < 20"""
)
def saved_searches(spark, sf_dir):
    """Two saved searches: one all of whose conditions must hold, one of which one is enough."""
    rows = [("s1", "title", "contains", "BOLT", False), ("s1", "type", "isNot", "promo", False), ("s1", "collection", "is", "c1", False), ("s1", "key", "isGreaterThan", "300", False), ("s2", "author", "is", "Brand#12", True), ("s2", "key", "isLessThan", "20", True)]
    searches = spark.createDataFrame(rows, "search string, field string, operator string, value string, any boolean")
    columns = {"title": "title", "type": "item_type", "collection": "collections", "key": "key", "author": "author"}
    items = catalogue(spark, sf_dir)
    found = lambda s: stats.saved_search(items, searches, s, columns).select("key")
    return found("s1").unionByName(found("s2").select((-F.col("key")).alias("key")))
