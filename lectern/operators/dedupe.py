"""Duplicate detection in a catalogue: strong keys, fuzzy weak keys, components, canonical record, evaluation.

Items: key, item_type, title, author (comparison form is derived), year INT, strong_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import identifiers as ids
from lectern.functions import text as tx
from lectern.functions.similarity import at_most, jaro_winkler_udf, letters
from lectern.operators.graph import connected_components
from lectern.operators.similar import BLOCK, meet, similar_texts, with_keys
from lectern.storage import materialize


def candidates(items: DataFrame) -> DataFrame:
    """Comparison forms of key, item_type, title, author, date, doi and, where present, isbn and pmid."""
    optional = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    return items.select(
        "key", "item_type", tx.normalize_title(F.coalesce("title", F.lit(""))).alias("title_key"), F.nullif(tx.normalize_surname("author"), F.lit("")).alias("author_key"),
        tx.first_year("date").alias("year"), ids.strong_key(F.col("doi"), optional("isbn"), optional("pmid")).alias("strong_key"),
    )


def strong_edges(c: DataFrame) -> DataFrame:
    """(src, dst): every holder of a shared strong key to the least one: a star, never all pairs."""
    groups = c.where("strong_key is not null").groupBy("strong_key").agg(F.min("key").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(groups, "strong_key").where(F.col("key") != F.col("dst")).select(F.col("key").alias("src"), "dst")


def folded(c: DataFrame) -> DataFrame:
    """Distinct comparison forms with a title and a type, each with its least key: equal items are compared once."""
    return c.where((F.col("title_key") != "") & F.col("item_type").isNotNull()).groupBy("item_type", "title_key", "author_key", "year").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))


def _compared(c: DataFrame, reach: int, width: int) -> DataFrame:
    """Pairs (l_*, r_*) of distinct comparison forms of one type whose year buckets are at most ``reach`` apart, and of forms without a year with all dated ones.

    A block is a type and a bucket of years; its right side is dealt to as many parts as its size asks
    for, which the left side meets one by one, so no task holds a large block whole. Buckets of forms
    without a year are all those that their type has.
    """
    columns = ("title_key", "author_key", "year", "rep", "letters")
    f = materialize(folded(c).withColumn("letters", letters(F.col("title_key"))), "forms")
    side = lambda df, p: df.select("item_type", "bucket", *[F.col(x).alias(f"{p}_{x}") for x in columns])
    dated = f.where("year is not null").withColumn("bucket", F.floor(F.col("year") / width))
    sizes = dated.groupBy("item_type", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    near = dated.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach)))
    undated = f.where("year is null").join(sizes.select("item_type", "bucket"), "item_type").select(*near.columns)
    left = side(near.unionByName(undated), "l").join(sizes, ["item_type", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = side(dated, "r").join(sizes, ["item_type", "bucket"]).withColumn("part", F.pmod(F.xxhash64("r_rep"), F.col("parts")).cast("int")).drop("parts")
    pairs = left.join(right, ["item_type", "bucket", "part"])
    pairs = pairs.where(F.col("l_year").isNull() | (F.col("l_rep") < F.col("r_rep")))
    return pairs.withColumn("bound", at_most(F.col("l_title_key"), F.col("r_title_key"), F.col("l_letters"), F.col("r_letters"))).drop("bucket", "part", "l_letters", "r_letters")


#: The place of forms that meet forms of any year, and of forms in groups that need no keys of authors.
ANY, WHOLE = -(1 << 31), 0


def _title_pairs(forms: DataFrame, threshold: float) -> DataFrame:
    """(item_type, title_key, other, title_score): similar titles of a type in both directions; equal titles are left out."""
    found = materialize(similar_texts(forms.select("item_type", "title_key").distinct(), "item_type", "title_key", threshold), "titles")
    way = lambda a, b: found.select("item_type", F.col(a).alias("title_key"), F.col(b).alias("other"), F.col("score").alias("title_score"))
    return way("l", "r").unionByName(way("r", "l"))


def _with_others(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows with every title that theirs matches (``other``), their own with score 1 among them."""
    own = rows.withColumn("other", F.col("title_key")).withColumn("title_score", F.lit(1.0))
    return own.unionByName(rows.join(titles, ["item_type", "title_key"]).select(*own.columns))


def weak_pairs(c: DataFrame, title_threshold: float = 0.9, author_threshold: float = 0.9, year_tolerance: int = 1) -> DataFrame:
    """(src, dst, title_score, author_score, year_gap): pairs of distinct comparison forms, by their least keys, that match.

    Same type; titles and authors at least as similar as their thresholds, years within the tolerance; a
    missing author or one missing year skips that test, two missing years are not compared.

    Distinct titles of a type are matched first, through an index of their rare letters; forms then meet by
    equal title, or matched title, and year. Where over BLOCK forms stand at one type, title and year, authors
    meet by such an index too, so no group is ever compared whole.
    """
    return _weak(materialize(folded(c), "forms"), title_threshold, author_threshold, year_tolerance)[0]


def _weak(forms: DataFrame, title_threshold: float, author_threshold: float, year_tolerance: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``weak_pairs``, and the pairs of titles that they come from."""
    titles = _title_pairs(forms, title_threshold)
    years = F.when(F.col("year").isNull(), F.array(F.lit(ANY).cast("int"))).otherwise(F.sequence(F.col("year") - year_tolerance, F.col("year") + year_tolerance))
    columns = ("author_key", "year", "rep")
    left = _with_others(forms, titles).select("item_type", F.col("other").alias("title_key"), F.explode(years).alias("slot"), *[F.col(x).alias(f"l_{x}") for x in columns], "title_score")
    right = forms.where("year is not null").select("item_type", "title_key", F.explode(F.array(F.col("year"), F.lit(ANY).cast("int"))).alias("slot"), *[F.col(x).alias(f"r_{x}") for x in columns])
    place = ["item_type", "title_key", "slot"]
    large = right.groupBy(*place).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK).select(*place, F.lit(True).alias("large"))
    left = _keyed(left.join(large, place, "left"), "l_author_key", author_threshold, True)
    right = _keyed(right.join(large, place, "left"), "r_author_key", author_threshold, False)
    pairs = meet(left, right, [*place, "key"]).where(F.col("l_year").isNull() | (F.col("l_rep") < F.col("r_rep")))
    pairs = pairs.select("l_rep", "r_rep", "l_author_key", "r_author_key", "title_score", F.abs(F.col("l_year") - F.col("r_year")).alias("year_gap"), "large")
    pairs = pairs.where("large is null").unionByName(pairs.where("large").distinct())  # only keys of authors bring a pair together twice
    pairs = pairs.withColumn("author_score", jaro_winkler_udf("l_author_key", "r_author_key")).where(F.coalesce(F.col("author_score") >= author_threshold, F.lit(True)))
    return pairs.select(F.greatest("l_rep", "r_rep").alias("src"), F.least("l_rep", "r_rep").alias("dst"), "title_score", "author_score", "year_gap"), titles


def _keyed(rows: DataFrame, author: str, threshold: float, is_left: bool) -> DataFrame:
    """Rows by the keys at which they meet: one for all in small groups; in large ones those of the author, one of any author and one of none."""
    small = rows.where("large is null").withColumn("key", F.lit(WHOLE).cast("long"))
    keyed = with_keys(rows.where("large"), author, threshold, "shorter", "longer")
    # either text may be the shorter one: what one side holds as the shorter the other holds as the longer
    marked = lambda keys, mark: F.transform(F.col(keys), lambda k: F.xxhash64(k, F.lit(mark)))
    own = F.concat(marked("shorter", 0 if is_left else 1), marked("longer", 1 if is_left else 0))
    anyone, nobody = F.array(F.lit(1).cast("long")), F.array(F.lit(2).cast("long"))
    keys = F.when(F.col(author).isNull(), anyone if is_left else F.concat(anyone, nobody)).otherwise(F.concat(own, nobody if is_left else anyone))
    keyed = keyed.withColumn("key", F.explode(F.array_distinct(keys))).drop("shorter", "longer")
    met = small.unionByName(keyed.select(*small.columns))
    return met if is_left else met.drop("large")


def _pairs_counted(counts: DataFrame, titles: DataFrame | None, reach: int) -> DataFrame:
    """One row ``n``: pairs of distinct forms with matching titles (``titles`` None: of any) whose slots differ by ``reach`` at most, and of undated with dated ones.

    counts: item_type, title_key, slot (null: undated), n. Pairs are products of counts; none is formed.
    """
    left = (_with_others(counts, titles) if titles is not None else counts.withColumn("other", F.col("title_key"))).select("item_type", F.col("other").alias("title_key"), "slot", F.col("n").alias("l_n"))
    near = F.when(F.col("slot").isNull(), F.array(F.lit(ANY).cast("long"))).otherwise(F.sequence(F.col("slot") - reach, F.col("slot") + reach))
    left = left.groupBy("item_type", "title_key", "slot").agg(F.sum("l_n").alias("l_n")).withColumn("undated", F.col("slot").isNull()).withColumn("slot", F.explode(near))
    dated = counts.where("slot is not null").withColumn("slot", F.explode(F.array(F.col("slot"), F.lit(ANY).cast("long")))).groupBy("item_type", "title_key", "slot").agg(F.sum("n").alias("r_n"))
    met = left.join(dated, ["item_type", "title_key", "slot"]).agg(
        F.coalesce(F.sum(F.when(F.col("undated"), F.col("l_n") * F.col("r_n"))), F.lit(0)).alias("u"), F.coalesce(F.sum(F.when(~F.col("undated"), F.col("l_n") * F.col("r_n"))), F.lit(0)).alias("d")
    )
    forms = counts.where("slot is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("self"))
    return met.join(forms).select((F.col("u") + (F.col("d") - F.col("self")).cast("long") / F.lit(2)).cast("long").alias("n"))  # one row each


def rejected_counts(c: DataFrame, title_threshold: float = 0.9, author_threshold: float = 0.9, year_tolerance: int = 1) -> DataFrame:
    """(reason, n): how many pairs ``rejected_pairs`` holds for each reason, without forming them.

    Compared pairs, those with matching titles and those with matching titles and years are products of
    counts by type, title and year; the last step takes the matching pairs off.
    """
    forms = materialize(folded(c), "forms")
    weak, titles = _weak(forms, title_threshold, author_threshold, year_tolerance)
    width = max(1, year_tolerance + 1)
    by = lambda title, slot: forms.groupBy("item_type", title.alias("title_key"), slot.cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.col("year") / width)
    compared = _pairs_counted(by(F.lit(""), bucket), None, 2).select(F.col("n").alias("compared"))
    titled = _pairs_counted(by(F.col("title_key"), bucket), titles, 2).select(F.col("n").alias("titled"))
    dated = _pairs_counted(by(F.col("title_key"), F.col("year")), titles, year_tolerance).select(F.col("n").alias("dated"))
    one = compared.join(titled).join(dated).join(weak.agg(F.count(F.lit(1)).alias("matched")))  # one row each
    steps = (("title", F.col("compared") - F.col("titled")), ("year", F.col("titled") - F.col("dated")), ("author", F.col("dated") - F.col("matched")))
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), n.alias("n")) for r, n in steps]))).where("n > 0")


def rejected_pairs(c: DataFrame, title_threshold: float = 0.9, author_threshold: float = 0.9, year_tolerance: int = 1) -> DataFrame:
    """(first, second, reason): compared pairs of distinct comparison forms that do not match, with the first test that fails.

    Compared are forms of one type whose year buckets are at most two apart, and forms without a year with
    all dated ones of the type. These are many, one for nearly every two forms: take a limit, or ``rejected_counts`` for their numbers.
    """
    pairs = _compared(c, 2, max(1, year_tolerance + 1))
    open_ = F.col("bound") >= title_threshold - 1e-9  # the others fail by their letters, and are not scored
    pairs = pairs.withColumn("t", jaro_winkler_udf(F.when(open_, F.col("l_title_key")), F.when(open_, F.col("r_title_key"))))
    passed = F.col("t") >= title_threshold
    pairs = pairs.withColumn("a", jaro_winkler_udf(F.when(passed, F.col("l_author_key")), F.when(passed, F.col("r_author_key"))))
    far = F.coalesce(F.abs(F.col("l_year") - F.col("r_year")) > year_tolerance, F.lit(False))
    reason = F.when(~F.coalesce(passed, F.lit(False)), "title").when(far, "year").when(F.col("a") < author_threshold, "author")
    return pairs.select(F.least("l_rep", "r_rep").alias("first"), F.greatest("l_rep", "r_rep").alias("second"), reason.alias("reason")).where("reason is not null")


def equal_form_edges(c: DataFrame) -> DataFrame:
    """(src, dst): items of equal comparison form to the least one of them; without a year equal items are not compared."""
    f = folded(c).where("n > 1 and year is not null").select(*[F.col(x).alias(f"f_{x}") for x in ("item_type", "title_key", "author_key", "year", "rep")])
    same = (F.col("item_type") == F.col("f_item_type")) & (F.col("title_key") == F.col("f_title_key")) & F.col("author_key").eqNullSafe(F.col("f_author_key")) & (F.col("year") == F.col("f_year"))
    return c.join(f, same).where(F.col("key") != F.col("f_rep")).select(F.col("key").alias("src"), F.col("f_rep").alias("dst"))


def clusters(items: DataFrame, attachment_counts: DataFrame, **thresholds) -> DataFrame:
    """(cluster_id, key, n_members, match_type, match_key, primary): members of clusters of two or more.

    attachment_counts: key, n_attachments and, where known, n_annotations. The primary record has most
    attachments, then most annotations, collections and fields, then the least key. match_type is the best kind of strong key that members share, else weak; match_key is the
    primary's own shared key of that kind, else the least one, else the primary's title.
    """
    c = materialize(candidates(items), "candidates")
    edges = strong_edges(c).unionByName(weak_pairs(c, **thresholds).select("src", "dst")).unionByName(equal_form_edges(c))
    members = connected_components(edges).withColumnRenamed("id", "key").withColumnRenamed("component", "cluster_id")
    shared = c.where("strong_key is not null").groupBy("strong_key").agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    facts = (
        items.select("key", F.size("collections").alias("n_collections"), tx.completeness(F.col("title"), F.col("doi"), tx.first_year("date"), F.when(F.col("author") != "", 1).otherwise(0)).alias("fields"))
        .join(attachment_counts, "key", "left")
        .join(c.select("key", "title_key", "strong_key"), "key")
        .join(shared, "strong_key", "left")
    )
    rank = F.when(F.col("n_key").isNull(), 0).when(F.col("strong_key").startswith("doi:"), 3).when(F.col("strong_key").startswith("isbn:"), 2).otherwise(1)
    rows = members.join(facts, "key").withColumn("rank", rank)
    notes = F.coalesce("n_annotations", F.lit(0)) if "n_annotations" in attachment_counts.columns else F.lit(0)
    order = F.struct(-F.coalesce("n_attachments", F.lit(0)), -notes, -F.col("n_collections"), -F.col("fields"), "key")
    per = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_members"), F.max("rank").alias("best"), F.min_by(F.struct("key", "title_key", "strong_key", "rank"), order).alias("p"), F.min(F.struct(-F.col("rank"), "strong_key")).alias("own")
    )
    per = per.select(
        "cluster_id", "n_members", F.element_at(F.array(*map(F.lit, ("weak", "pmid", "isbn", "doi"))), F.col("best") + 1).alias("match_type"),
        F.when(F.col("best") == 0, F.col("p.title_key")).when(F.col("p.rank") == F.col("best"), F.col("p.strong_key")).otherwise(F.col("own.strong_key")).alias("match_key"), F.col("p.key").alias("primary"),
    )
    return members.join(per, "cluster_id")


def cluster_reasons(c: DataFrame, members: DataFrame, **thresholds) -> DataFrame:
    """(cluster_id, reasons): the sorted distinct reasons why a cluster's members were joined.

    A shared strong key names itself; a fuzzy match names its scores with three decimals; equal forms say so.
    """
    three = lambda x: F.format_string("%.3f", x)
    strong = strong_edges(c).join(c.select(F.col("key").alias("dst"), "strong_key"), "dst").select("src", F.concat(F.lit("same "), "strong_key").alias("reason"))
    author = F.coalesce(F.concat(F.lit(", author "), three(F.col("author_score"))), F.lit(""))
    weak = weak_pairs(c, **thresholds).select("src", F.concat(F.lit("title "), three(F.col("title_score")), author).alias("reason"))
    same = equal_form_edges(c).select("src", F.lit("same form").alias("reason"))
    rows = strong.unionByName(weak).unionByName(same).join(members.select(F.col("key").alias("src"), "cluster_id"), "src")
    return rows.select("cluster_id", "reason").distinct().groupBy("cluster_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))


def cluster_statistics(found: DataFrame) -> DataFrame:
    """One row from the rows of ``clusters``: clusters, strong and weak ones, and the items in them."""
    per = found.groupBy("cluster_id").agg(F.min("match_type").alias("kind"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("kind") != "weak").alias("strong"), F.count_if(F.col("kind") == "weak").alias("weak"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
    )


def pair_metrics(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, from (key, cluster_id) and (key, group_id).

    Pairs are counted from group sizes: a group of n has n(n-1)/2, and pairs in both are counted from
    the sizes of the intersections, so no pair is ever written out.
    """
    pairs = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long")
    size = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    p = size(predicted, "cluster_id").agg(pairs.alias("predicted_pairs"))
    t = size(labelled, "group_id").agg(pairs.alias("labelled_pairs"))
    b = size(predicted.join(labelled, "key"), "cluster_id", "group_id").agg(pairs.alias("tp"))
    m = p.join(t).join(b)  # one row each
    return m.select(
        "tp", (F.col("predicted_pairs") - F.col("tp")).alias("fp"), (F.col("labelled_pairs") - F.col("tp")).alias("fn"),
        F.when(F.col("predicted_pairs") == 0, 1.0).otherwise(F.round(F.col("tp") / F.col("predicted_pairs"), 6)).alias("precision"),
        F.when(F.col("labelled_pairs") == 0, 1.0).otherwise(F.round(F.col("tp") / F.col("labelled_pairs"), 6)).alias("recall"),
    )
