"""How sources differ from their language and from each other: smoothed term probabilities in whole numbers.

Terms of a group that stand out most are found by bounds: a group's terms are put into buckets by their count, and the
probability of the bucket's largest count less the smallest probability that any of its terms has in the language
bounds every difference in it. Buckets are looked at best bound first, until the k-th difference found is above the bounds of all others.
Differences between sources come from postings: terms that neither of two sources has differ alike, terms of one
of them follow from its counts, and only terms of both are met one by one, in the posting of the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.term_counts import grouped_terms
from lectern.storage import materialize

#: Documents of a language that hold a kept term, at least; scale and smoothing of probabilities; terms reported a group.
DOCUMENTS, UNIT, SMOOTH, TERMS = 30, 1_000_000_000, 5, 50
#: Postings of one task, about, and sources of one block of a language.
POSTINGS, SOURCES = 200_000, 256


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), in whole numbers of 38 digits; null where no term is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    under = wide(total + SMOOTH * kept)
    return F.when(kept > 0, F.call_function("div", over, under) + 1)


def kept_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the terms in at least DOCUMENTS documents of their language, and their count in the language.

    One shuffle by language and term serves the sums by source and the sums by language.
    """
    parts = grouped_terms(docs, text_col, lang_col, source_col)
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_df", F.sum("df").over(of_term))
    return counts.where(F.col("lang_df") >= DOCUMENTS).select("lang", "source", "term", "n", "lang_n")


def group_facts(docs: DataFrame, counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, place, kept, total, lang_total, n_terms, slices, blocks, p0): every group of the documents, numbered inside its language.

    slices and blocks say into how many parts the language's postings and sources are dealt.
    """
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.groupBy(column(lang_col).alias("lang"), column(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    terms = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    facts = groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", *map(zero, ("kept", "total", "lang_total", "n_terms")))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    of_lang = Window.partitionBy("lang")
    slices = F.greatest(F.lit(1), F.ceil(F.sum("n_terms").over(of_lang) / POSTINGS)).cast("int").alias("slices")
    blocks = F.ceil(F.count(F.lit(1)).over(of_lang) / SOURCES).cast("int").alias("blocks")
    return facts.select("*", place, slices, blocks, probability(F.lit(0), F.col("total"), F.col("kept")).alias("p0"))


def top_terms(scored: DataFrame, k: int = TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the k terms of each group that stand out most. scored: lang, source, term, n, lang_n, p, q.

    Exact: a bucket is left out only when its bound is strictly below the group's k-th value.
    """
    # about four buckets an octave of counts: the position of the leading bit and the two bits behind it
    bits = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    bucket = (bits * 4 + F.floor((F.col("n") / F.pow(F.lit(2.0), bits) - 1) * 4)).cast("int")
    scored = scored.withColumn("bucket", bucket)
    bounds = scored.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count_if(F.col("p") > F.col("q")).alias("held")).where("bound > 0")
    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = materialize(bounds.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))), "term-bounds")
    key = ["lang", "source", "bucket"]
    differing = scored.where("p > q").withColumn("value", F.col("p") - F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the best buckets that together hold k terms give the k-th value so far; then every bucket that may still reach it is evaluated
    first = materialize(best(differing.join(bounds.where(F.col("ahead") < k).select(*key), key, "left_semi").select("lang", "source", "term", "value")), "first-terms")
    reached = first.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    open_ = bounds.where(F.col("ahead") >= k).join(reached, ["lang", "source"], "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0)))
    more = differing.join(open_.select(*key), key, "left_semi").select("lang", "source", "term", "value")
    both = first.select("lang", "source", "term", "value").unionByName(best(more).drop("rank"))
    return best(both).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _shared(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, source, sum) over the terms of both: |p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|, for postings of one slice."""
    term = pa.concat_arrays(batch["term"].chunks).dictionary_encode().indices.to_numpy() if batch.num_rows else np.zeros(0, np.int32)
    place, p, p0 = (batch[c].to_numpy() for c in ("place", "p", "p0"))
    order = np.lexsort((place, term))
    term, place, p, p0 = term[order], place[order], p[order], p0[order]
    places, column = np.unique(place, return_inverse=True)
    zero = np.zeros(len(places), np.int64)
    zero[column] = p0
    n, sums = len(places), np.zeros((len(places), len(places)), np.int64)
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(term)))
    for k in np.unique(length[length > 1]).tolist():
        starts = first[length == k]
        step = max(1, (1 << 20) // (k * k))
        for lo in range(0, len(starts), step):
            at = starts[lo : lo + step, None] + np.arange(k)
            c, v = column[at], p[at]
            z = zero[c]
            own, cross = np.abs(v[:, :, None] - v[:, None, :]), np.abs(v[:, :, None] - z[:, None, :])
            value = own - cross - cross.transpose(0, 2, 1) + np.abs(z[:, :, None] - z[:, None, :])
            np.add.at(sums.reshape(-1), (c[:, :, None] * n + c[:, None, :]).reshape(-1), value.reshape(-1))
    i, j = np.nonzero(sums)
    return places[i], places[j], sums[i, j]


def _postings(width: int):
    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        left, right = key[-2].as_py(), key[-1].as_py()
        a, b, v = _shared(batch)
        mine = (a // width == left) & (b // width == right) | (a // width == right) & (b // width == left)
        return pa.table({"lang": pa.array([key[0].as_py()] * int(mine.sum()), pa.string()), "place": a[mine], "other": b[mine], "shared": v[mine]})

    return run


def _own(key: tuple[pa.Scalar, ...], counts: pa.Table, others: pa.Table) -> pa.Table:
    """For each other source of a group: the sum over the group's terms of |p - p0'| - |p0 - p0'|, from its distinct probabilities."""
    p, m = counts["p"].to_numpy().astype(np.int64), counts["m"].to_numpy().astype(np.int64)
    order = np.argsort(p)
    p, m = p[order], m[order]
    terms, sums = np.concatenate(([0], np.cumsum(m))), np.concatenate(([0], np.cumsum(p * m)))
    z, own = others["o_p0"].to_numpy().astype(np.int64), others["own_p0"].to_numpy().astype(np.int64)
    below = np.searchsorted(p, z)
    total = (z * terms[below] - sums[below]) + (sums[-1] - sums[below] - z * (terms[-1] - terms[below]))
    return pa.table({"lang": others["o_lang"], "place": others["o_place"], "other": others["o_other"], "own": total - terms[-1] * np.abs(own - z)})


def pair_values(scored: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over all kept terms of |p - p'| for every two sources of a language. scored: lang, term, place, slices, blocks, p, p0."""
    g = facts.select("lang", "source", "place", "kept", "p0", "n_terms")
    h = facts.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("p0").alias("z0"))
    # the result itself has a row for every two sources of a language
    pairs = materialize(g.join(h, "lang").where("place <> other"), "source-pairs")
    histogram = scored.groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("m"))
    asked = pairs.where("n_terms > 0").select(F.col("lang").alias("o_lang"), F.col("place").alias("o_place"), F.col("other").alias("o_other"), F.col("p0").alias("own_p0"), F.col("z0").alias("o_p0"))
    own = histogram.groupBy("lang", "place").cogroup(asked.groupBy("o_lang", "o_place")).applyInArrow(_own, "lang string, place int, other int, own long")
    own = materialize(own, "own-sums")
    mine = F.floor(F.col("place") / SOURCES).cast("int")
    placed = scored.select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "term", "place", "p", "p0", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("peer"))
    placed = placed.select("lang", "slice", F.least("mine", "peer").alias("left"), F.greatest("mine", "peer").alias("right"), "term", "place", "p", "p0")
    shared = placed.groupBy("lang", "slice", "left", "right").applyInArrow(_postings(SOURCES), "lang string, place int, other int, shared long")
    shared = shared.groupBy("lang", "place", "other").agg(F.sum("shared").alias("shared"))
    back = own.select("lang", F.col("place").alias("other"), F.col("other").alias("place"), F.col("own").alias("theirs"))
    key = ["lang", "place", "other"]
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("kept") * F.coalesce(F.abs(F.col("p0") - F.col("z0")), F.lit(0))
    joined = pairs.join(own, key, "left").join(back, key, "left").join(shared, key, "left")
    return joined.select("lang", "source", "item", (base + none("own") + none("theirs") + none("shared")).cast("long").alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of the documents.

    part ``pair``: each other source of the language, with the sum over the language's kept terms of the differences of their
    probabilities; part ``term``: the up to TERMS terms that the source uses and has more often than its language, with the
    difference. Ranks go by value, descending, then by item in the order of its bytes.

    Defined cases: null text, lang and source count as empty; each row is a document, whatever its id, so repeated
    rows count each; a language without kept terms has pairs of value 0 and no terms; a source without kept terms has the
    probabilities of count 0; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    counts = materialize(kept_terms(docs, text_col, lang_col, source_col), "kept-terms")
    facts = materialize(group_facts(docs, counts, lang_col, source_col), "groups")
    small = facts.drop("n_terms")
    scored = counts.join(small, ["lang", "source"]).select(
        "lang", "source", "place", "slices", "blocks", "term", "n", "p0",
        probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    scored = materialize(scored, "scored-terms")
    pairs = pair_values(scored, facts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top_terms(scored), "term"))
