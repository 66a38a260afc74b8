"""Library health, listings and search over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize


def library_stats(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: items, and how many lack a PDF, a DOI, metadata or a collection, and authors who occur more than once.

    A missing date is a null date: an unreadable one is there.
    """
    pdf = attachments.where(F.col("content_type") == "application/pdf").select(F.col("parent").alias("key")).distinct().withColumn("has_pdf", F.lit(True))
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    counts = items.join(pdf, "key", "left").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("has_pdf").isNull()).alias("missing_pdf"),
        F.count_if(empty("doi")).alias("missing_doi"),
        F.count_if(empty("title") | F.col("date").isNull() | empty("author")).alias("missing_metadata"),
        F.count_if(F.size("collections") == 0).alias("unfiled"),
    )
    return counts.join(repeated(items.where(~empty("author")), "author"))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many values occur more than once."""
    return rows.groupBy(column).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_creators"))


def in_trash(items: DataFrame, trashed: DataFrame) -> DataFrame:
    """Items with a boolean column ``deleted``: flagged by themselves (a truthy ``deleted``) or listed in ``trashed`` (key)."""
    flag = F.lower(F.col("deleted").cast("string")).isin("1", "true") if "deleted" in items.columns else F.lit(False)
    listed = trashed.select("key").distinct().withColumn("_listed", F.lit(True))
    return items.join(listed, "key", "left").withColumn("deleted", F.coalesce(flag, F.lit(False)) | F.coalesce("_listed", F.lit(False))).drop("_listed")


def matching(
    query: str, columns: list[str], item_type: str | None = None, collection: str | None = None, tag: str | None = None, deleted: bool | None = None
) -> Column:
    """The condition that any of the columns contains the query (every item where there are none) and all filters hold.

    Filters: item type, membership of a collection, a tag of ``tags`` (array of names), and the boolean ``deleted``.
    """
    wanted = F.lit(query.lower())
    hit: Column = F.lit(not columns)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    if item_type is not None:
        hit = hit & (F.col("item_type") == item_type)
    if collection is not None:
        hit = hit & F.array_contains("collections", collection)
    if tag is not None:
        hit = hit & F.array_contains("tags", tag)
    if deleted is not None:
        hit = hit & (F.col("deleted") == deleted)
    return hit


def search(items: DataFrame, query: str, columns: list[str], limit: int = 25, start: int = 0, **filters) -> DataFrame:
    """Items that are ``matching``, in key order; at least one, ``limit`` at most."""
    return items.where(matching(query, columns, **filters)).orderBy("key").offset(start).limit(max(1, limit))


#: Conditions of one saved search, at most: they become one expression.
MAX_CONDITIONS = 500


def _holds(row, columns: dict[str, str]) -> Column:
    """One condition of a saved search on the column that its field names."""
    c, value = F.col(columns[row["field"]]), row["value"] or ""
    some = (lambda test: F.exists(c, test)) if row["field"] in ("tag", "collection") else (lambda test: test(c.cast("string")))
    low = value.lower()
    tests = {
        "is": lambda x: F.lower(x) == low, "contains": lambda x: F.contains(F.lower(x), F.lit(low)), "beginsWith": lambda x: F.startswith(F.lower(x), F.lit(low)),
        "isLessThan": lambda x: x.try_cast("double") < F.lit(value).try_cast("double"), "isGreaterThan": lambda x: x.try_cast("double") > F.lit(value).try_cast("double"),
        "isBefore": lambda x: x < value, "isAfter": lambda x: x > value,
    }
    negated = {"isNot": "is", "doesNotContain": "contains"}
    operator = row["operator"]
    if operator not in tests and operator not in negated:
        raise ValueError(f"unknown operator {operator}")
    found = F.coalesce(some(tests[negated.get(operator, operator)]), F.lit(False))
    return ~found if operator in negated else found


def saved_search(items: DataFrame, searches: DataFrame, search_key: str, columns: dict[str, str]) -> DataFrame:
    """Items that a saved search finds. searches: search, field, operator, value, and any (whether one condition is enough; the same in all rows of a search).

    columns names the column of each field; tag and collection are arrays of which one element must fit. Operators: is, isNot, contains,
    doesNotContain, beginsWith, isLessThan, isGreaterThan (numbers), isBefore, isAfter (texts), without case. A null fits no condition but the negated ones. Raises
    ValueError for an unknown search, field or operator, and beyond MAX_CONDITIONS.
    """
    rows = searches.where(F.col("search") == search_key).limit(MAX_CONDITIONS + 1).collect()
    if not rows or len(rows) > MAX_CONDITIONS:
        raise ValueError(f"no search {search_key}" if not rows else f"more than {MAX_CONDITIONS} conditions")
    unknown = sorted({r["field"] for r in rows} - columns.keys())
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    either = bool(rows[0]["any"])
    hit = F.lit(not either)
    for r in rows:
        hit = hit | _holds(r, columns) if either else hit & _holds(r, columns)
    return items.where(hit)


def collection_paths(collections: DataFrame, max_depth: int = 200) -> DataFrame:
    """(key, name, parent, path, level) of a collection table (key, name, parent); orphans count as roots.

    Level by level from the roots, joined on the parent, until a level is empty; a cycle has no root and
    does not appear. Each level is written once. Raises RuntimeError when levels go on beyond ``max_depth``.
    """
    known = collections.select(F.col("key").alias("known"))
    parents = collections.join(known, F.col("parent") == F.col("known"), "left")
    level = parents.where("known is null").select("key", "name", "parent", F.col("name").alias("path"), F.lit(0).alias("level"))
    level = out = materialize(level, "collection-level")
    for k in range(1, max_depth + 2):
        above = level.select(F.col("key").alias("parent"), F.col("path").alias("above"))
        level = collections.join(above, "parent").select("key", "name", "parent", F.concat_ws(" / ", "above", "name").alias("path"), F.lit(k).alias("level"))
        level = materialize(level, "collection-level")
        if level.isEmpty():
            return out
        if k > max_depth:
            raise RuntimeError(f"collections go deeper than {max_depth} levels")
        out = out.unionByName(level)
    return out
