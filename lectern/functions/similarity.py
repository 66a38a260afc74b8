"""Jaro-Winkler similarity for Arrow batches; Spark has no built-in."""

from __future__ import annotations

import functools
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from 0 to 1: prefix weight 0.1 for up to four characters at any score, half transpositions counted as halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, deque[int]] = defaultdict(deque)
    for j, c in enumerate(b):
        places[c].append(j)
    pairs = []  # each character of a with the first free equal one of b within reach
    for i, c in enumerate(a):
        free = places.get(c)
        if free is None:
            continue
        while free and free[0] < i - reach:
            free.popleft()
        if free and free[0] <= i + reach:
            pairs.append((c, free.popleft()))
    m = len(pairs)
    if not m:
        return 0.0
    in_order = [b[j] for j in sorted(j for _, j in pairs)]
    half = sum(c != d for (c, _), d in zip(pairs, in_order))
    score = (m / len(a) + m / len(b) + (m - half / 2) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return score + same * 0.1 * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = jaro_winkler(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


#: Characters that ``letters`` tells apart; all others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(c: Column) -> Column:
    """struct(a, b, c, more): up to four occurrences of each of LETTERS and of anything else as bits of three longs, and the number beyond; made before rows are paired."""
    each = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    each.append(F.length(c) - F.length(F.regexp_replace(c, f"[^{LETTERS}]", "")))
    bits = lambda n: F.when(n > 3, 15).when(n == 3, 7).when(n == 2, 3).otherwise(n).cast("long")
    words = []
    for k in range(0, len(each), 16):
        word = F.lit(0).cast("long")
        for j, n in enumerate(each[k : k + 16]):
            word = word.bitwiseOR(F.shiftleft(bits(n), 4 * j))
        words.append(word)
    more = functools.reduce(lambda x, y: x + y, [F.greatest(n - 4, F.lit(0)) for n in each])
    return F.struct(*[w.alias(x) for w, x in zip(words, "abc")], more.alias("more"))


def at_most(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """An upper bound of ``jaro_winkler(a, b)`` from the letters and the common prefix, compiled by Spark.

    No more characters match than both texts hold of each kind, and no transposition is the best case.
    """
    shared = functools.reduce(lambda x, y: x + y, [F.bit_count(a_letters[w].bitwiseAND(b_letters[w])) for w in "abc"]) + F.least(a_letters["more"], b_letters["more"])
    jaro = F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise((shared / F.length(a) + shared / F.length(b) + 1) / 3)
    prefix = F.lit(0)
    for n in (1, 2, 3, 4):
        prefix = F.when(F.substring(a, 1, n) == F.substring(b, 1, n), n).otherwise(prefix)
    return jaro + prefix * 0.1 * (1 - jaro)
