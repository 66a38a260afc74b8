"""Joins on "contains": which texts hold which strings, by an index of short grams instead of comparing every pair.

Each string is anchored at its rarest gram. A text can hold the string only where it holds that gram, so texts and strings meet
on it, and the pairs that meet are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Characters of a gram; shorter strings are grams of their own length.
GRAM = 12


def squeezed(c: Column) -> Column:
    """A text without any white space."""
    return F.regexp_replace(c, "(?U)\\s+", "")


def _grams(text: Column, size: int) -> Column:
    """All grams of a text, in order, in one pass over it; none of a shorter one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def containing(strings: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(string_id, text_id): every string (id, value) that is part of a text (id, value), white space aside. Exact.

    Equal strings are searched once. The anchor of a string is the gram of it that the fewest strings and texts hold, so
    that a phrase in most texts is no meeting point unless a string consists of such phrases alone. Null, empty and blank strings are in no
    text.
    """
    wanted = strings.select(F.col("id").alias("string_id"), squeezed(F.col("value")).alias("value")).where("value <> ''")
    distinct = materialize(wanted.select("value").distinct().withColumn("size", F.least(F.char_length("value"), F.lit(gram))), "strings")
    held = materialize(texts.select(F.col("id").alias("text_id"), squeezed(F.col("value")).alias("text")).where("text <> ''"), "texts")
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # at most ``gram`` of them
    found = None
    for size in sizes:
        of_size = distinct.where(F.col("size") == size)
        offered = of_size.select("value", F.explode(F.array_distinct(_grams(F.col("value"), size))).alias("gram"))
        there = held.select("text_id", "text", F.explode(F.array_distinct(_grams(F.col("text"), size))).alias("gram"))
        # grams of texts are kept only where a string has them; then both are counted
        met = materialize(there.select("text_id", "gram").join(offered.select("gram").distinct(), "gram", "left_semi"), "grams")
        often = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # a string with a gram that no text holds is in none
        rare = offered.join(often, "gram", "left").groupBy("value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")).where("a.n > 0").select("value", F.col("a.gram").alias("gram"))
        pairs = met.join(rare, "gram").join(held, "text_id").where(F.col("text").contains(F.col("value"))).select("value", "text_id")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return wanted.select("string_id").limit(0).join(held.select("text_id").limit(0))
    return found.join(wanted, "value").select("string_id", "text_id")


def page_heads(heads: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: pages, matched and share. heads: key, page, head; segments: key, page, text: whether each page's first words stand in the segment that boundaries give it."""
    both = heads.join(segments.select("key", "page", F.col("text").alias("segment")), ["key", "page"], "left")
    head = squeezed(F.col("head"))
    hit = F.coalesce((head != "") & squeezed(F.col("segment")).contains(head), F.lit(False))
    counted = both.agg(F.count(F.lit(1)).alias("pages"), F.count_if(hit).alias("matched"))
    return counted.withColumn("share", F.round(F.col("matched") / F.col("pages"), 4))
