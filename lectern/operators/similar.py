"""Similarity joins of short texts by Jaro-Winkler: an inverted index of rare letters that is exact for its threshold.

With m matching characters and p equal first ones (at most four) a score of t asks for
m/|a| + m/|b| >= k(p) = 3 (t - p/10) / (1 - p/10) - 1. No more characters match than both texts hold, so
the texts share that many of their letters, told apart by letter and occurrence. If a text must share o of its n letters,
one of its n - o + 1 rarest is among the rarest ones of its partner too: only texts that meet at such a key are ever paired.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.similarity import at_most, jaro_winkler_udf, letters
from lectern.storage import materialize

#: Letters of titles from common to rare; all others count as rarer still.
COMMON = " eatinosrlhdcumfpgwybvkxjqz0123456789"
#: Lengths are told apart by powers of this ratio.
RATIO = 1.25
#: Rows of one key that one part of a join holds, about; keys with more are dealt to several parts.
BLOCK = 4096
#: Rounding slack of bounds.
SLACK = 1e-6
#: Equal first characters that a class of pairs has at most, and how many it has at least, which its keys hold.
HEADS = ((4, 4), (3, 1), (0, 0))


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(RATIO)).cast("int")


def _rarest_first(c: Column) -> Column:
    """The letters of a text, rarest first; the order is the same for all texts."""
    codes = "".join(chr(0xF8FF - k) for k in range(len(COMMON)))
    return F.array_sort(F.regexp_extract_all(F.translate(c, COMMON, codes), F.lit("(?s)."), F.lit(0)))


def with_keys(df: DataFrame, text: str, threshold: float, shorter: str, longer: str) -> DataFrame:
    """``df`` with two arrays of keys: two texts that score the threshold or more share a key of ``shorter`` of the one and ``longer`` of the other.

    ``shorter`` is that of the text with fewer characters, of either one where they have equally many. A
    null or empty text has no keys. The threshold must lie above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and not above 1")
    df = df.withColumn("_sorted", _rarest_first(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_tokens", F.transform("_sorted", lambda x, i: F.concat(x, (i - F.array_position("_sorted", x)).cast("string"))))
    both = [_keys(F.col(text), threshold, most, held) for most, held in HEADS]
    return df.withColumn(shorter, F.concat(*[s for s, _ in both])).withColumn(longer, F.concat(*[g for _, g in both])).drop("_sorted", "_tokens")


def _keys(text: Column, threshold: float, most: int, held: int) -> tuple[Column, Column]:
    """Keys of pairs with ``most`` equal first characters at most, ``held`` at least: of the shorter text and of the longer one."""
    n = F.size("_tokens")
    k = 3 * (threshold - most / 10) / (1 - most / 10) - 1
    bounded = k - 1 >= 0.2  # below, texts of any two lengths may match, and lengths are not told apart
    head, own = F.substring(text, 1, held), _length_class(n) if bounded else F.lit(0)

    def rarest(shared: Column) -> Column:
        return F.slice("_tokens", 1, F.greatest(F.lit(1), F.least(n, n - F.ceil(shared - SLACK).cast("int") + 1)))

    def key(length_class: Column, token: Column) -> Column:
        return F.xxhash64(F.lit(most), head, length_class, token)

    def of_class(c: Column) -> Column:
        least = F.greatest(F.pow(F.lit(RATIO), c.cast("double")) - SLACK, n * (k - 1) - SLACK, F.lit(1.0)) if bounded else F.lit(1.0)
        return F.transform(rarest(n * k * least / (n + least)), lambda x: key(c, x))

    classes = F.sequence(_length_class(F.ceil(n * (k - 1) - SLACK)), own) if bounded else F.array(F.lit(0))
    guard = lambda keys: F.when(n >= max(1, held), keys).otherwise(F.array().cast("array<bigint>"))
    return guard(F.transform(rarest(n * (k / 2)), lambda x: key(own, x))), guard(F.flatten(F.transform(classes, of_class)))


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``; the right rows of a key that has over BLOCK of them are dealt to parts, which the left rows meet one by one."""
    large = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1")
    cut = lambda df: df.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), F.col("parts")).cast("int")
    left = cut(left).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(cut(right).withColumn("part", spread).drop("parts"), [*keys, "part"]).drop("part")


def similar_texts(texts: DataFrame, group: str, text: str, threshold: float) -> DataFrame:
    """(group, l, r, score): pairs of distinct texts of one group that score the threshold or more, l before r.

    texts: a group and a text a row, distinct; null groups, null and empty texts pair with nothing.
    """
    rows = texts.select(F.col(group).alias("g"), F.col(text).alias("s")).where(F.col("g").isNotNull() & (F.col("s") != ""))
    rows = materialize(rows.withColumn("letters", letters(F.col("s"))).withColumn("n", F.length("s")), "texts")
    keyed = with_keys(rows, "s", threshold, "shorter", "longer")
    side = lambda keys, p: keyed.select("g", F.explode(F.array_distinct(keys)).alias("key"), *[F.col(c).alias(f"{p}_{c}") for c in ("s", "n", "letters")])
    pairs = meet(side("shorter", "l"), side("longer", "r"), ["g", "key"])
    ordered = (F.col("l_n") < F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l_s") < F.col("r_s")))
    pairs = pairs.where(ordered & (at_most(F.col("l_s"), F.col("r_s"), F.col("l_letters"), F.col("r_letters")) >= threshold - 1e-9))
    pairs = pairs.select("g", F.least("l_s", "r_s").alias("l"), F.greatest("l_s", "r_s").alias("r")).distinct()
    return pairs.withColumn("score", jaro_winkler_udf("l", "r")).where(F.col("score") >= threshold).withColumnRenamed("g", group)
