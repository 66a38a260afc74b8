"""Exports put together in order: numbered rows that files are written from, without a task or a string that holds a whole export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.numbering import numbered
from lectern.storage import materialize

#: Export formats whose parts are JSON.
JSON_FORMATS = ("csljson", "json")


def wanted_keys(keys: DataFrame) -> DataFrame:
    """(ord, key) of (ord, key): trimmed, without blanks, each at its first place."""
    rows = keys.select("ord", F.trim("key").alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.min("ord").alias("ord"))


def merged(keys: DataFrame, parts: DataFrame, export_format: str) -> DataFrame:
    """(number, text, entries): the merged export of parts (key, body) in the order of keys (ord, key); written line by line it is the file.

    JSON parts that are arrays are laid out, others count as one element; the file is one array. Other formats
    are texts without the white space around them, empty ones left out, with a blank line between. entries is what a row adds to the number of exported
    entries. Keys without a part and parts without a key add nothing; without any element JSON is an empty array and text an empty file.
    """
    rows = parts.join(wanted_keys(keys), "key")
    if export_format in JSON_FORMATS:
        body = F.trim("body")
        elements = F.when(body.startswith("["), F.from_json(body, "array<string>")).when(body != "", F.array(body))
        rows = rows.select("ord", "key", F.posexplode(elements).alias("pos", "text"))
    else:
        text = F.regexp_replace("body", "^\\s+|\\s+$", "")
        rows = rows.select("ord", "key", F.lit(0).alias("pos"), text.alias("text")).where("text <> ''")
    placed = materialize(numbered(rows, [F.col("ord"), F.col("key"), F.col("pos")]).select("number", "text"), "merged")
    total = placed.count()
    last = F.col("number") == total - 1
    if export_format not in JSON_FORMATS:
        return placed.select("number", F.when(last, F.col("text")).otherwise(F.concat("text", F.lit("\n"))).alias("text"), F.lit(1).alias("entries"))
    if not total:
        return placed.sparkSession.createDataFrame([(0, "[]", 0)], "number long, text string, entries int")
    text = F.concat(F.when(F.col("number") == 0, "[\n").otherwise(""), F.lit("  "), F.col("text"), F.when(last, "\n]").otherwise(","))
    return placed.select("number", text.alias("text"), F.lit(1).alias("entries"))


def write_in_order(rows: DataFrame, path: str, number: str = "number", text: str = "text", overwrite: bool = False) -> None:
    """Write the texts as lines of files under ``path`` whose names are in the order of ``number``: concatenated, they are the export.

    Raises an error where ``path`` exists, unless it may be overwritten.
    """
    ordered = rows.repartitionByRange(number).sortWithinPartitions(number).select(text)
    ordered.write.mode("overwrite" if overwrite else "errorifexists").text(path)
