"""Change plans as tables: diff, last write, apply with versions, rollback; tags, annotations, attachments, merges.

Items in long form: key, version, field, value. Operations: seq, key, field, value, expected_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.numbering import numbered_within

#: Fields that no plan may write.
READ_ONLY = ("key", "version", "dateAdded", "dateModified")
#: Fields that one update may write, at most: they are broadcast.
MAX_FIELDS = 1000


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, field, before, after, destructive) of fields that change, for keys that exist; destructive overwrites something."""
    a = after.where(~F.col("field").isin(*READ_ONLY)).select("key", "field", F.col("value").alias("after"))
    known = before.select("key").distinct()
    b = before.select("key", "field", F.col("value").alias("before"))
    rows = a.join(known, "key", "left_semi").join(b, ["key", "field"], "left")
    return rows.where(~F.col("before").eqNullSafe(F.col("after"))).select("key", "field", "before", "after", (F.coalesce("before", F.lit("")) != "").alias("destructive"))


def last_per_field(operations: DataFrame) -> DataFrame:
    """The last operation on each (key, field): a combinable aggregate, not a window."""
    rest = [c for c in operations.columns if c not in ("key", "field")]
    last = operations.groupBy("key", "field").agg(F.max_by(F.struct(*rest), "seq").alias("o"))
    return last.select("key", "field", "o.*")


def plan_updates(keys: DataFrame, fields: DataFrame) -> DataFrame:
    """Each key with each field of a field table that is small by nature (one row per column of an item); raises ValueError beyond MAX_FIELDS of them."""
    wanted = fields.where(~F.col("field").isin(*READ_ONLY))
    if wanted.limit(MAX_FIELDS + 1).count() > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    return keys.join(F.broadcast(wanted))


def apply(items: DataFrame, operations: DataFrame) -> DataFrame:
    """(key, version, field, value) after the operations whose expected version still holds; touched items rise by one version.

    Operations on other versions are conflicts (see ``conflicts``) and change nothing; null values remove a field.
    """
    versions = items.select("key", "version").distinct()
    valid = last_per_field(operations.where(~F.col("field").isin(*READ_ONLY))).join(versions, "key").where(F.col("expected_version") == F.col("version"))
    new = valid.select("key", "field", F.col("value").alias("new"), F.lit(True).alias("written"))
    touched = new.select("key").distinct().withColumn("touched", F.lit(1))
    cells = items.select("key", "field", "value").join(new, ["key", "field"], "full_outer")
    cells = cells.select("key", "field", F.when(F.col("written"), F.col("new")).otherwise(F.col("value")).alias("value")).where("value is not null")
    return cells.join(versions, "key").join(touched, "key", "left").select("key", (F.col("version") + F.coalesce("touched", F.lit(0))).alias("version"), "field", "value")


def conflicts(items: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations whose item has another version than expected, or does not exist."""
    versions = items.select("key", "version").distinct()
    return operations.join(versions, "key", "left").where(~F.col("expected_version").eqNullSafe(F.col("version")))


def rollback(snapshot: DataFrame, current: DataFrame, created: DataFrame) -> DataFrame:
    """(key, action, field, value): restore fields of the snapshot that differ, blank fields added since, remove created items that still exist."""
    s, c = snapshot.select("key", "field", F.col("value").alias("old")), current.select("key", "field", F.col("value").alias("now"))
    both = s.join(c, ["key", "field"], "full_outer").join(snapshot.select("key").distinct(), "key", "left_semi")
    restore = both.where(~F.col("old").eqNullSafe(F.col("now"))).select("key", F.lit("restore").alias("action"), "field", F.coalesce("old", F.lit("")).alias("value"))
    alive = created.join(current.select("key").distinct().withColumn("alive", F.lit(True)), "key", "left")
    nothing = F.lit(None).cast("string")
    return restore.unionByName(alive.select("key", F.when(F.col("alive"), "remove").otherwise("already-gone").alias("action"), nothing.alias("field"), nothing.alias("value")))


def add_tags(tags: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(tags, new))


def remove_tags(tags: Column, gone: Column) -> Column:
    return F.filter(tags, lambda t: ~F.array_contains(gone, t))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)))


def new_annotations(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Annotations of a batch that the library does not hold yet, by type, position, text and comment; the batch itself is not reduced."""
    keys = ["type", "position", "text", "comment"]
    same = F.lit(True)
    e = existing.select(*[F.col(k).alias(f"e_{k}") for k in keys]).distinct()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    return batch.join(e, same, "left_anti")


def label_backfill(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_key, target_key, before, after): annotations paired one to one by text and page, in key order; labels that differ.

    Candidates of one (text, page) are interchangeable, so the k-th source meets the k-th target. They are numbered by range
    totals, so that a text on a page may have any number of them.
    """
    text = lambda c: F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "\\s+", " ")
    placed = lambda rows: numbered_within(rows.where("page is not null").select("key", "page", "label", text(F.col("text")).alias("t")), ["t", "page"], [F.col("key")], "k")
    s, g = placed(source.where(F.coalesce("label", F.lit("")) != "")), placed(target)
    pairs = s.select("t", "page", "k", F.col("key").alias("source_key"), F.col("label").alias("after")).join(g.select("t", "page", "k", F.col("key").alias("target_key"), F.col("label").alias("before")), ["t", "page", "k"])
    return pairs.where(~F.col("before").eqNullSafe(F.col("after"))).select("source_key", "target_key", "before", "after")


def attachments_to_create(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(parent, path) whose file is not attached yet; paths compare with / and without case."""
    form = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    have = existing.select("parent", form(F.col("path")).alias("p")).distinct()
    return wanted.withColumn("p", form(F.col("path"))).join(have, ["parent", "p"], "left_anti").drop("p")


def merge_impacts(groups: DataFrame) -> DataFrame:
    """(group_id, primary_key, n_members, children, tags, collections) of (group_id, key, is_primary, children, tags, collections): sums and unions."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return groups.groupBy("group_id").agg(
        F.max(F.when(F.col("is_primary"), F.col("key"))).alias("primary_key"), F.count(F.lit(1)).alias("n_members"), F.sum("children").alias("children"), union("tags").alias("tags"), union("collections").alias("collections")
    )


def reparent(children: DataFrame, members: DataFrame) -> DataFrame:
    """Children of merged items moved to their primary; members: key, primary_key."""
    return children.join(members.select(F.col("key").alias("parent"), "primary_key"), "parent", "left").withColumn("parent", F.coalesce("primary_key", "parent")).drop("primary_key")


def creations(rows: DataFrame) -> DataFrame:
    """(ord, ref, field, value) of new items from (ord, item_type, fields): fields is a map; read-only and null fields are left out.

    ref is @created: with ord, the operation's place in its plan, by which later operations name the item before
    it has a key. Rows without a type are documents.
    """
    first = F.struct(F.lit("itemType").alias("field"), F.coalesce("item_type", F.lit("document")).alias("value"))
    given = F.transform(F.filter(F.map_entries("fields"), lambda e: e["value"].isNotNull() & ~e["key"].isin(*READ_ONLY, "itemType")), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    ref = F.concat(F.lit("@created:"), F.col("ord").cast("string"))
    return rows.select("ord", ref.alias("ref"), F.explode(F.concat(F.array(first), F.coalesce(given, F.array().cast("array<struct<field:string,value:string>>")))).alias("f")).select("ord", "ref", "f.*")


def membership(collections: Column, add: Column, remove: Column) -> Column:
    """Collections of an item after removals and additions: the old order, new ones behind, none twice."""
    return F.array_distinct(F.concat(F.array_except(collections, remove), F.array_except(add, remove)))


def preview(changes: DataFrame, longest: int = 40) -> DataFrame:
    """(key, lines) of (key, field, before, after, destructive): one line a change, by field, long values cut for reading; a destructive one is marked."""
    shown = lambda c: F.when(c.isNull(), "(none)").when(F.char_length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(c)
    line = F.concat(F.when(F.col("destructive"), "! ").otherwise("  "), F.col("field"), F.lit(": "), shown(F.col("before")), F.lit(" -> "), shown(F.col("after")))
    return changes.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))


def apply_lifecycle(items: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, version, deleted) after creations, trashing and deletions. items: key, version, deleted; steps: key, kind, expected_version.

    create adds a missing key with version 1; trash marks, restore unmarks and delete removes an item, when its version is the expected
    one and, for delete, it is in the trash already or trashed by the same plan. Each change of an item raises its version by one.
    """
    per = steps.groupBy("key").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("create", "trash", "restore", "delete")], F.min("expected_version").alias("expected"))
    both = items.join(per, "key", "full_outer")
    valid = F.coalesce(F.col("expected") == F.col("version"), F.lit(False))
    does = lambda k: F.coalesce(F.col(k), F.lit(False)) & valid
    trashed = F.when(does("trash"), True).when(does("restore"), False).otherwise(F.col("deleted"))
    gone = does("delete") & (F.coalesce("deleted", F.lit(False)) | does("trash"))
    made = F.col("version").isNull() & F.coalesce("create", F.lit(False))
    kept = both.where((F.col("version").isNotNull() & ~gone) | made)
    return kept.select("key", F.when(made, 1).otherwise(F.col("version") + (~trashed.eqNullSafe(F.col("deleted"))).cast("int")).cast("long").alias("version"), F.when(made, False).otherwise(trashed).alias("deleted"))
