"""Mixing sources to target weights: hash thresholds found in histograms, without sorting documents.

Every document has a place between 0 and 1 by a hash of its id and text. Words are summed by source and
hash bucket; running sums of the buckets show in which one a source's budget ends. Only the documents of
that bucket are looked at again, by the next digit of the hash, until few are left. The thresholds are nested:
a smaller budget takes a subset of what a larger one takes. A last pass filters by comparing the hash.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.numbering import numbered
from lectern.storage import materialize

#: Weights of the sources in their order, repeating; share of all words that is taken (3/2); how often a source may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), (3, 2), 2
#: Bits of one digit of the hash (buckets of a source in one histogram), and documents of a source that one task orders at the end.
DIGIT, LAST = 10, 4096
#: Sources whose thresholds are sent to every task; beyond, documents meet them by a join that deals each source out to SALTS tasks.
BROADCAST_SOURCES, SALTS = 100_000, 64

_HASH_BITS, _TIE_BITS = 60, 70
#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h, u): words of each document, 60 bits of md5 of its id and text, and a number that tells equal documents apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key), 1, _HASH_BITS // 4), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("u"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, budget) of (source, source_size): the share of all words by weight, no source above REPEATS times its size.

    Sources are ordered by code point, null last. Targets are min(REPEATS * size, weight * level), where level makes them
    sum up to the share: it is found by Newton steps, each one aggregate over the sources, in whole numbers. budget is the target
    in whole words.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int")).cast("long")
    ranked = materialize(ranked.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight")), "source-weights")
    cap = F.lit(REPEATS) * F.col("source_size")
    wide = lambda c: c.cast("decimal(38,0)")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, weights = Fraction(SHARE[0], SHARE[1]) * total, ranked.agg(F.sum("weight")).first()[0] or 1
    level: Fraction | None = None
    while True:
        now = left / weights if weights else level or Fraction(0)
        if level is not None and now <= level:
            break
        level = now
        above = wide(cap) * F.lit(level.denominator).cast("decimal(38,0)") <= wide(F.col("weight")) * F.lit(level.numerator).cast("decimal(38,0)")
        capped, weights = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        left, weights = Fraction(SHARE[0], SHARE[1]) * total - (capped or 0), weights or 0
    share = wide(F.col("weight")) * F.lit(level.numerator).cast("decimal(38,0)")
    below = F.lit(level.denominator).cast("decimal(38,0)")
    full = wide(cap) * below <= share
    target = F.when(full, cap.cast("double")).otherwise(share.cast("double") / below.cast("double"))
    budget = F.when(full, cap).otherwise(F.call_function("div", share, below))
    return ranked.select("source", "source_size", target.alias("target"), budget.cast("long").alias("budget"))


def _digit(k: int) -> Column:
    """The k-th digit of a document's place: of its hash, then of the number that tells equal documents apart."""
    mask = F.lit((1 << DIGIT) - 1)
    if k < _HASH_BITS // DIGIT:
        return F.shiftright("h", _HASH_BITS - DIGIT * (k + 1)).bitwiseAND(mask).cast("int")
    return F.shiftright("u", _TIE_BITS - DIGIT * (k - _HASH_BITS // DIGIT + 1)).bitwiseAND(mask).cast("int")


def _met(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """rows joined with one row a source; sources are renamed _source there, null meets null."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(by_source), same)
    salted = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("_salt"))).drop("salt", "_salt")


def thresholds(rows: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """(source, h_end, u_end, before): the document at which each source's ``rest`` words end, and the words of those in front of it.

    Sources without a rest do not appear. rows: source, size, h, u; state: source, rest.
    """
    rest = state.where("rest > 0").select(F.col("source").alias("_source"), "rest", F.lit(0).cast("long").alias("before"))
    candidates, level = rows.where("size > 0"), 0
    found = None
    while True:
        # a histogram of one digit: at most 2^DIGIT rows a source, however many documents it has
        sums = candidates.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        ahead = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = _met(sums.withColumn("u", F.col("digit").cast("long")), rest, n_sources).drop("u")
        sums = sums.withColumn("ahead", F.col("before") + F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        edge = sums.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") >= F.col("rest")))
        edge = materialize(edge.select(F.col("source").alias("_source"), "rest", F.col("ahead").alias("before"), F.col("digit").alias("_digit"), "n"), "edge")
        largest = edge.agg(F.max("n")).first()[0]
        if largest is None:
            return edge.select(F.col("_source").alias("source"), F.lit(0).cast("long").alias("h_end"), F.lit(0).cast("long").alias("u_end"), "before")
        inside = _met(candidates, edge.drop("n"), n_sources).where(_digit(level) == F.col("_digit"))
        level += 1
        if largest <= LAST or level * DIGIT >= _HASH_BITS + _TIE_BITS:
            found = inside
            break
        candidates = materialize(inside.select("source", "size", "h", "u"), "edge-bucket")
        rest = edge.drop("_digit", "n")
    order = Window.partitionBy("source").orderBy("h", "u").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = found.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("size") >= F.col("rest")))
    return last.select("source", F.col("h").alias("h_end"), F.col("u").alias("u_end"), F.col("ahead").alias("before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A source whose budget is below its size is taken once as far as its threshold; one above its size is taken whole
    and once more as far as its threshold. The one document at the threshold gives only its first words of that round, so that a
    source's taken words sum up to its target in whole words, exactly. The hash depends on id and text alone: reruns agree.

    Defined cases: one row a row of docs; null text has size 0 and is taken 0; a null source is a source, the last one;
    a null id hashes by its text; rows that repeat id and text are taken one after the other; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = materialize(measured(docs, id_col, text_col, source_col), "measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes)
    goals = goals.withColumn("base", (F.col("budget") >= F.col("source_size")).cast("long")).withColumn("rest", F.col("budget") - F.col("base") * F.col("source_size"))
    goals = materialize(goals, "targets")
    n_sources = goals.count()
    ends = materialize(thresholds(rows.select("source", "size", "h", "u"), goals.select("source", "rest"), n_sources), "thresholds")
    e = ends.select(F.col("source").alias("e_source"), "h_end", "u_end", "before")
    plan = goals.join(e, F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("_source"), "source_size", "target", "base", "rest", "h_end", "u_end", "before")
    met = _met(rows, plan, n_sources)
    in_front = (F.col("h") < F.col("h_end")) | ((F.col("h") == F.col("h_end")) & (F.col("u") < F.col("u_end")))
    at_end = (F.col("h") == F.col("h_end")) & (F.col("u") == F.col("u_end"))
    more = F.when(in_front, F.col("size")).when(at_end, F.col("rest") - F.col("before")).otherwise(0)
    return met.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, text) of the mix, one row a copy; the document at a source's threshold is cut after its last taken word.

    Needs unique ids: documents meet their counts by id.
    """
    taken = mix(docs, id_col, text_col, source_col).select(F.col("doc_id").alias("_id"), "size", "taken").where("taken > 0")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).join(taken, F.col("doc_id") == F.col("_id"))
    copy = F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("n")
    rows = rows.select("doc_id", "source", "text", "size", "taken", copy)
    rest = (F.col("taken") - F.col("n") * F.col("size")).cast("int")
    runs = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), F.lit(0))  # words and gaps take turns
    led = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    cut = F.array_join(F.slice(runs, F.lit(1), 2 * rest - 1 + led), "")
    return rows.select("doc_id", "source", F.when(rest >= F.col("size"), F.col("text")).otherwise(cut).alias("text"))
