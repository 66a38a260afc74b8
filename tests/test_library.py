import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import identifiers as ids
from lectern.functions import text as tx
from lectern.functions.similarity import jaro_winkler
from lectern.operators import dedupe, enrichment, exports, pages
from lectern.plans import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, title",
    [("The  Théorie—des Ensembles!", "theorie des ensembles"), ("A the Thing", "the thing"), ("机器学习 Intro", "机器学习 intro"), ("ＡＢ １２", "ab 12"), ("!!", ""), ("Anna", "anna")],
)
def test_normalize_title(spark, raw, title):
    assert one(spark, tx.normalize_title(F.lit(raw))) == title


def test_identifiers(spark):
    assert one(spark, ids.strong_key(F.lit(" https://doi.org/10.1/AB "), F.lit("1"), F.lit("2"))) == "doi:10.1/ab"
    assert one(spark, ids.strong_key(F.lit("  "), F.lit("978-0-306x"), F.lit("2"))) == "isbn:9780306X"
    assert one(spark, ids.strong_key(F.lit(None).cast("string"), F.lit("-"), F.lit("pm 12"))) == "pmid:12"
    assert one(spark, ids.identifier_kind(F.lit("nothing"))) is None
    assert one(spark, ids.found_identifier(F.lit("see 10.1000/x.y; and")))["value"] == "10.1000/x.y"


def test_jaro_winkler_values():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1 and jaro_winkler("ab", "cd") == 0


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_winkler_is_bounded_and_reflexive(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1 and jaro_winkler(a, a) == 1


def test_clusters_strong_weak_and_distractors(spark):
    rows = [
        (1, "article", "Deep learning for protein folds", "Müller", "2020", "10.1/A", ["x"]), (2, "article", "Something else entirely", "Other", "1990", "https://doi.org/10.1/a", []),
        (3, "article", "Graph kernels in practice", "Smith", "2019", None, []), (4, "article", "Graph kernels in practise", "Smith", "2020", None, []), (5, "article", "Graph kernels in practice", "Smith", None, None, []),
        (6, "book", "Graph kernels in practice", "Smith", "2019", None, []), (7, "article", "Graph kernels in practice", "Nguyen", "2019", None, []), (8, "article", "Unique title of its own", "Smith", "2019", None, []),
    ]
    items = spark.createDataFrame(rows, "key long, item_type string, title string, author string, date string, doi string, collections array<string>")
    got = {r["key"]: r for r in dedupe.clusters(items, spark.createDataFrame([(2, 5)], "key long, n_attachments long")).collect()}
    assert {k: r["cluster_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert got[1]["primary"] == 2 and got[1]["match_type"] == "doi" and got[1]["match_key"] == "doi:10.1/a"
    assert got[3]["match_type"] == "weak" and got[3]["primary"] == 3
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6)], "key long, group_id long")
    m = dedupe.pair_metrics(spark.createDataFrame(list(got.values())).select("key", "cluster_id"), labels).first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"], m["recall"]) == (4, 0, 0, 1.0, 1.0)


def test_two_items_without_year_are_not_compared(spark):
    items = spark.createDataFrame([(k, "article", "Graph kernels in practice", "Smith", None, None, []) for k in (1, 2)], "key long, item_type string, title string, author string, date string, doi string, collections array<string>")
    assert dedupe.clusters(items, spark.createDataFrame([], "key long, n_attachments long")).count() == 0


TEXT = st.text("abc .\n。", max_size=400)


@given(TEXT, st.integers(4, 40))
def test_chunks_fit_and_advance(text, limit):
    spans = pages.chunk_spans(text, limit)
    assert all(0 <= a < b <= len(text) and n <= limit and n == len(text[a:b].split()) for a, b, n in spans)
    assert [a for a, _, _ in spans] == sorted(a for a, _, _ in spans)
    covered = set()
    for a, b, _ in spans:
        covered.update(range(a, b))
    assert all(c in ".。" or c.isspace() or k in covered for k, c in enumerate(text))


def test_chunk_overlap_is_real():
    text = "\n\n".join(" ".join(f"w{p}x{k}" for k in range(60)) for p in range(6))
    spans = pages.chunk_spans(text, 128)
    shares = [len(text[b0:a1].split()) for (_, a1, _), (b0, _, _) in zip(spans, spans[1:])]
    assert len(spans) > 2 and all(8 <= n <= 20 for n in shares)
    with pytest.raises(ValueError):
        pages.chunk_spans("x", 10, 0.5)


def test_page_table_cases(spark):
    rows = [("ok", "a b\fc\fd", None), ("none", "abc", None), ("count", "a\fb", 3), ("empty", "a\f \fb", None)]
    got = {(r["key"], r["page"]): r for r in pages.page_table(spark.createDataFrame(rows, "key string, text string, pages int")).collect()}
    assert [(got["ok", k]["start"], got["ok", k]["end"]) for k in range(3)] == [(0, 4), (4, 6), (6, 7)]
    assert [got[k, 0]["status"] for k in ("ok", "none", "count", "empty")] == ["ok", "no-separators", "count-mismatch", "empty-page"]


def test_block_is_idempotent_and_keeps_the_rest(spark):
    lines = F.array(F.lit("cited-by: 3"))
    once = one(spark, enrichment.apply_block(F.lit("mine"), lines, "t1"))
    assert once.startswith("mine\n<!--") and one(spark, enrichment.apply_block(F.lit(once), lines, "t2")) == once
    other = one(spark, enrichment.apply_block(F.lit(once + "\nafter"), F.array(F.lit("cited-by: 4")), "t2"))
    assert other.startswith("mine\n") and other.endswith("\nafter") and "cited-by: 4" in other and "cited-by: 3" not in other
    assert one(spark, enrichment.apply_block(F.lit("mine"), F.array().cast("array<string>"), "t")) == "mine"


def test_apply_and_rollback_round_trip(spark):
    items = spark.createDataFrame([("A", 1, "title", "x"), ("A", 1, "year", "1"), ("B", 2, "title", "y")], "key string, version int, field string, value string")
    ops = spark.createDataFrame([(1, "A", "title", "z", 1), (2, "A", "title", "w", 1), (1, "A", "note", "n", 1), (1, "B", "title", "q", 1), (1, "A", "version", "9", 1)], "seq int, key string, field string, value string, expected_version int")
    after = changes.apply(items, ops)
    assert {(r["key"], r["version"], r["field"], r["value"]) for r in after.collect()} == {("A", 2, "title", "w"), ("A", 2, "year", "1"), ("A", 2, "note", "n"), ("B", 2, "title", "y")}
    assert [r["key"] for r in changes.conflicts(items, ops).collect()] == ["B"]
    plan = changes.rollback(items, after, spark.createDataFrame([("C",)], "key string")).collect()
    assert {(r["key"], r["action"], r["field"], r["value"]) for r in plan} == {("A", "restore", "title", "x"), ("A", "restore", "note", ""), ("C", "already-gone", None, None)}


def test_bibliography_problems(spark):
    content = "@article{a,\n title={x}, author={y}, year={1}}\n@book{b,\n title={x}\n@misc nothing"
    got = exports.audit(spark.createDataFrame([("f", content)], "file string, content string")).collect()
    assert [(r["key"], sorted(r["problems"])) for r in got] == [("a", []), ("b", ["lacks author", "lacks year", "unbalanced"]), (None, ["no head"])]


def test_bibliographies_are_scanned_by_their_grammar():
    text = (
        'see title = {x}\n@string{a = "b"}\n@Article(k1, Title = "a {quoted "" b} = c, year = 1", author = {A (B) and {C}} # x, year = 2000)\n'
        "@comment{k, year = 1}\n@book{k2, abstract = {title = {no}, @home\n}, YEAR=1\n}\n@misc{k3}\n@misc{, title={t}}"
    )
    assert exports.scan(text) == [("article", "k1", ["title", "author", "year"], True), ("book", "k2", ["abstract", "year"], True), ("misc", "k3", [], True), ("misc", None, ["title"], True)]
    assert exports.scan("") == [] and exports.scan("@") == [] and exports.scan("@a{k, b = {x\n@c{d}") == [("a", "k", ["b"], False), ("c", "d", [], True)]


def test_identifiers_are_parsed_once(spark):
    raw = ["doi: 10.1/x", "HTTPS://dx.doi.org/10.5555/a b", "10.5555/abc", "10.55/abc", "ISBN 0-306-40615-2", "978 0 306 40615 7", "1234 5678", "12345678", "123456789", "PMID:  77 ", "x", "", None]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string").select("k", ids.parsed_identifier(F.col("raw")).alias("p")).orderBy("k").collect()
    kinds = ["doi", "doi", "doi", None, "isbn", "isbn", None, "pmid", None, "pmid", None, None, None]
    values = ["10.1/x", "10.5555/a b", "10.5555/abc", None, "0306406152", "9780306406157", None, "12345678", None, "77", None, None, None]
    assert [r["p"]["kind"] for r in rows] == kinds and [r["p"]["value"] for r in rows] == values
