"""Plans compiled from requests: rows of ``journal.OPERATION`` for renaming tags, adding items and importing files, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.plans.changes import READ_ONLY


def tag_holders(items: DataFrame, tag: str, keys: DataFrame | None = None) -> DataFrame:
    """The items (key, tags, ...) that hold a tag; with keys (key), only those of them."""
    rows = items.where(F.array_contains("tags", tag))
    return rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")


def _operation(kind: str, field: Column | None = None, value: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(kind).alias("kind"), text(field).alias("field"), text(value).alias("value"))


def _rows(rows: DataFrame, key: Column, version: Column, operations: Column) -> DataFrame:
    """Operations in the order of their array: seq counts within an item."""
    return rows.select(key.cast("string").alias("key"), version.cast("long").alias("expected_version"), F.posexplode(operations).alias("seq", "o")).select(F.col("seq").cast("long").alias("seq"), "key", "o.*", "expected_version")


def rename_tag(items: DataFrame, old: str, new: str, keys: DataFrame | None = None) -> DataFrame:
    """Operations that give the holders of a tag (key, version, tags) another one in its place; nothing where both are the same."""
    steps = F.array(_operation("remove-tag", value=F.lit(old)), _operation("add-tag", value=F.lit(new)))
    return _rows(tag_holders(items, old, keys).where(F.lit(old != new)), F.col("key"), F.col("version"), steps)


def created(ord_: Column) -> Column:
    """The name by which a plan speaks of an item before it has a key."""
    return F.concat(F.lit("@created:"), ord_.cast("string"))


def add_items(records: DataFrame) -> DataFrame:
    """Operations that create items from records (ord, item_type, fields, tags, collections): creation, then fields by name, tags and collections in order.

    fields is a map; read-only, null and empty ones are left out, as are null tags and collections. A record without a type is a document.
    """
    given = F.array_sort(F.filter(F.map_entries("fields"), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~e["key"].isin(*READ_ONLY, "itemType")))
    each = lambda c, kind: F.transform(F.array_compact(F.col(c)), lambda v: _operation(kind, value=v))
    none = F.array().cast("array<struct<kind:string,field:string,value:string>>")
    steps = F.concat(
        F.array(_operation("create", value=F.coalesce("item_type", F.lit("document")))), F.coalesce(F.transform(given, lambda e: _operation("set", e["key"], e["value"])), none),
        F.coalesce(each("tags", "add-tag"), none), F.coalesce(each("collections", "add-collection"), none),
    )
    return _rows(records, created(F.col("ord")), F.lit(None), steps)


def import_files(files: DataFrame) -> DataFrame:
    """Operations that create an item for each file (ord, path, title, kind, value) and a linked attachment under it.

    kind and value are what identification found; an item without a title is named after its file. The attachment's name in the plan is the item's with /file.
    """
    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    title = F.coalesce(F.nullif("title", F.lit("")), tx.title_from_file_name(name), name)
    identifier = F.when(F.col("kind").isin("doi", "isbn") & F.col("value").isNotNull(), F.array(_operation("set", F.upper("kind"), F.col("value")))).otherwise(F.array().cast("array<struct<kind:string,field:string,value:string>>"))
    item = F.concat(F.array(_operation("create", value=F.lit("document")), _operation("set", F.lit("title"), title)), identifier)
    ref = created(F.col("ord"))
    attachment = F.array(
        _operation("create", value=F.lit("attachment")), _operation("set", F.lit("parentItem"), ref), _operation("set", F.lit("linkMode"), F.lit("linked_file")), _operation("set", F.lit("path"), F.col("path")),
        _operation("set", F.lit("contentType"), tx.content_type(F.col("path"))),
    )
    nothing = F.lit(None)
    return _rows(files, ref, nothing, item).unionByName(_rows(files, F.concat(ref, F.lit("/file")), nothing, attachment))


def summary(operations: DataFrame) -> DataFrame:
    """(items, operations, text) of a plan: how many items it touches, how many operations it has, and how many of each kind, in the order of their names."""
    kinds = operations.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    text = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(k["n"].cast("string"), F.lit(" "), k["kind"])), ", ").alias("text"))
    return operations.agg(F.count_distinct("key").alias("items"), F.count(F.lit(1)).alias("operations")).join(text)
