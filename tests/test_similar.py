"""Similarity joins of titles and authors against all pairs scored one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.similarity import jaro_winkler
from lectern.operators import dedupe, similar


def _texts(rng, n):
    words = ["spark", "sparks", "query", "quick", "zebra", "index", "join", "a", "été", "数据", "𝒳", "of", "the", "optimal", "optimum"]
    out = {""} | {"x" * k for k in (1, 2, 3, 4, 5, 300, 330)}
    while len(out) < n:
        t = " ".join(rng.choices(words, k=rng.randrange(1, 6)))
        out.add(t)
        cut = rng.randrange(len(t) + 1)
        out.add(t[:cut] + rng.choice("qz e") + t[cut + rng.randrange(2) :])
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.95, 0.9, 0.6])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(similar, "BLOCK", 40)  # many keys are dealt to parts
    texts = _texts(random.Random(5), 160)
    rows = [(g, t) for g in ("a", "b") for t in texts] + [(None, "spark"), ("a", None)]
    got = similar.similar_texts(spark.createDataFrame(rows, "kind string, title string"), "kind", "title", threshold).collect()
    expected = {(a, b): jaro_winkler(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if a and jaro_winkler(a, b) >= threshold}
    assert {(r["kind"], r["l"], r["r"]) for r in got} == {(g, a, b) for g in ("a", "b") for a, b in expected}
    assert len(got) == 2 * len(expected)
    assert all(abs(r["score"] - expected[r["l"], r["r"]]) < 1e-12 for r in got)


def test_threshold_must_be_above_zero(spark):
    with pytest.raises(ValueError):
        similar.similar_texts(spark.createDataFrame([], "kind string, title string"), "kind", "title", 0.0)


def _forms(spark, seed):
    rng = random.Random(seed)
    authors = [None, "smith", "smyth", "smithe", "jones", "jonas", "li", "ng", "garcia", "garcía"]
    rows = [(k, rng.choice(["book", "article"]), rng.choice(["data lakes", "data lake", "query plans", "quarry plans", "zoo", ""]), rng.choice(authors), rng.choice([None, 1999, 2000, 2001, 2004, 2009])) for k in range(220)]
    return rows + [(900, None, "zoo", "li", 2000), (901, "book", None, "li", 2000)], "key long, item_type string, title_key string, author_key string, year int"


def _compared(rows):
    reps = {}
    for key, kind, title, author, year in rows:
        if kind is not None and title:
            form = (kind, title, author, year)
            reps[form] = min(key, reps.get(form, key))
    forms = sorted(reps.items(), key=lambda f: f[1])
    for a, i in forms:
        for b, j in forms:
            if a[0] == b[0] and b[3] is not None and (a[3] is None or i < j):
                yield a, i, b, j


@pytest.mark.parametrize(("block", "tolerance"), [(1, 1), (4096, 0), (1, 2)])
def test_weak_pairs_and_rejections_equal_brute_force(spark, monkeypatch, block, tolerance):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(dedupe, "BLOCK", block)  # with 1 all authors meet by their keys
    rows, schema = _forms(spark, 11)
    c = spark.createDataFrame(rows, schema)
    expected, rejected = {}, {"title": 0, "year": 0, "author": 0}
    width = max(1, tolerance + 1)
    for a, i, b, j in _compared(rows):
        t = jaro_winkler(a[1], b[1])
        gap = None if a[3] is None else abs(a[3] - b[3])
        s = None if a[2] is None or b[2] is None else jaro_winkler(a[2], b[2])
        near = gap is None or abs(a[3] // width - b[3] // width) <= 2
        if t < 0.9:
            rejected["title"] += near
        elif gap is not None and gap > tolerance:
            rejected["year"] += near
        elif s is not None and s < 0.9:
            rejected["author"] += 1
        else:
            expected[max(i, j), min(i, j)] = (t, s, gap)
    got = dedupe.weak_pairs(c, year_tolerance=tolerance).collect()
    assert len(got) == len(expected)
    assert {(r["src"], r["dst"]): (r["title_score"], r["author_score"], r["year_gap"]) for r in got} == expected
    counts = dedupe.rejected_counts(c, year_tolerance=tolerance)
    assert {r["reason"]: r["n"] for r in counts.collect()} == {k: v for k, v in rejected.items() if v}
    if block > 1:
        listed = dedupe.rejected_pairs(c, year_tolerance=tolerance).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()
        assert {r["reason"]: r["n"] for r in listed} == {k: v for k, v in rejected.items() if v}


def test_empty_catalogue(spark):
    c = spark.createDataFrame([], "key long, item_type string, title_key string, author_key string, year int")
    assert dedupe.weak_pairs(c).count() == 0 and dedupe.rejected_counts(c).count() == 0
