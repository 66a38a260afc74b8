"""Cases that once went wrong: caps, lost items, crashes and order."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import storage
from lectern.functions import similarity
from lectern.functions import text as tx
from lectern.operators import dedupe, identify, pages, records, search, semantic, stats
from lectern.plans import changes


def test_numeric_references_are_decoded(spark):
    rows = [("a&#233;&#xE9;&#128512; &amp;#233; &#38;lt; &#60;b&#62; x&#39;y", "aéé😀 &#233; &lt; <b> x'y"), ("&#0; &#1114112; &#xD800; &#;", "&#0; &#1114112; &#xD800; &#;"), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame(rows, "html string, expected string")
    assert [(r["t"], r["expected"]) for r in df.select(tx.plain_text(F.col("html")).alias("t"), "expected").collect()] == [(e, e) for _, e in rows]


def test_archives_are_guarded(spark):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.xml", "x" * 10), z.writestr("b.xml", "y" * 1000), z.writestr("c.bin", "z")
    df = spark.createDataFrame([("good", good.getvalue()), ("bad", b"no archive")], "path string, content binary")
    got = {(r["file"], r["name"], r["content"] and bytes(r["content"]), r["error"]) for r in records.packed_parts(df, most=100).collect()}
    assert got == {("good", "a.xml", b"x" * 10, None), ("good", "b.xml", None, "too large"), ("bad", None, None, "BadZipFile")}


def test_deep_collections_and_many_fields(spark):
    chain = spark.createDataFrame([(f"k{n}", f"n{n}", f"k{n - 1}" if n else None) for n in range(40)], "key string, name string, parent string")
    assert stats.collection_paths(chain).agg(F.max("level")).first()[0] == 39
    with pytest.raises(RuntimeError):
        stats.collection_paths(chain, max_depth=5)
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert changes.plan_updates(keys, spark.range(1000).select(F.col("id").cast("string").alias("field"))).count() == 2000
    with pytest.raises(ValueError):
        changes.plan_updates(keys, spark.range(1001).select(F.col("id").cast("string").alias("field")))


def test_the_watermark_waits_for_texts_that_did_not_come(spark, tmp_path):
    folder, model = str(tmp_path / "index"), semantic.character_embedder(8)
    manifest = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, version long")
    texts = spark.createDataFrame([("a", "text of a"), ("b", "text of b"), ("c", "text of c")], "key string, text string")
    assert semantic.update(folder, texts.where("key <> 'b'"), manifest, model)["embedded"] == 2
    assert semantic.update(folder, texts, manifest, model)["embedded"] == 1
    assert {r["key"] for r in semantic.passages(spark, folder).collect()} == {"a", "b", "c"}


def test_storage_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_annotations_decide_between_equally_attached_records(spark):
    items = spark.createDataFrame([(k, "article", "Graph kernels in practice", "Smith", "2001", None, ["C"] * (3 - k)) for k in (1, 2)], "key long, item_type string, title string, author string, date string, doi string, collections array<string>")
    counts = spark.createDataFrame([(1, 2, 0), (2, 2, 5)], "key long, n_attachments long, n_annotations long")
    assert {r["primary"] for r in dedupe.clusters(items, counts).collect()} == {2}
    assert dedupe.cluster_statistics(dedupe.clusters(items, counts)).first().asDict() == {"clusters": 1, "strong": 0, "weak": 1, "items": 2, "surplus": 1}


def test_the_letter_bound_is_never_below_the_similarity(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé 12") for _ in range(rng.randrange(0, 14)))
    rows = [(word(), word()) for _ in range(400)] + [("graph kernels", "graph kernel"), ("aaaaaaaa", "aaaaaaab"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("la", similarity.letters(F.col("a"))).withColumn("lb", similarity.letters(F.col("b")))
    for r in df.select("a", "b", similarity.at_most(F.col("a"), F.col("b"), F.col("la"), F.col("lb")).alias("u")).collect():
        assert r["a"] == r["b"] or r["u"] >= similarity.jaro_winkler(r["a"], r["b"]) - 1e-9


def test_embedded_metadata_of_awkward_files():
    packet = '<x:xmpmeta><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="d"><rdf:Description dc:format="p"><dc:creator><rdf:Seq><rdf:li>Ann Lee</rdf:li><rdf:li>Bo &amp; Co</rdf:li></rdf:Seq></dc:creator><dc:date><rdf:Seq><rdf:li>2020-03-04T05:06</rdf:li></rdf:Seq></dc:date></rdf:Description></rdf:RDF></x:xmpmeta>'
    assert identify.metadata_of(packet) == (None, "Ann Lee; Bo & Co", "2020-03-04", None)
    assert identify.metadata_of("/Title (A \\(nested (one)\\) \\101\\\nB) /CreationDate (D:20191231235959)") == ("A (nested (one)) AB", None, "2019-12-31", None)
    assert identify.metadata_of("/Title (never ends") == (None, None, None, None) and identify.metadata_of(None) == (None, None, None, None)
    assert identify.metadata_of("/Title <FEFF00E9> /Author <zz>")[:2] == ("é", None)
    assert identify.metadata_of('<!DOCTYPE x [<!ENTITY a "b">]><rdf:RDF><rdf:Description dc:title="t"/></rdf:RDF>')[0] == "t"


def test_chunks_of_a_long_sentence_are_linear_and_labelled(spark):
    import time

    text = "word " * 200_000
    began = time.process_time()
    spans = pages.chunk_spans(text, 128)
    assert time.process_time() - began < 5 and spans[-1][1] == len(text) - 1
    texts = spark.createDataFrame([("a", "one two\fthree four\ffive", 3, ["i", " ", "iii"]), ("b", "one two three four", 2, None), ("c", "one two", None, None)], "key string, text string, pages int, labels array<string>")
    got = {(r["key"], r["idx"]): (r["page_label"], r["estimated"]) for r in pages.labelled_chunks(pages.chunk(texts, 2), texts).collect()}
    assert got["a", 0] == ("i", False) and got["b", 0] == ("1", True) and got["c", 0] == (None, False)
    assert {v for k, v in got.items() if k[0] == "a"} == {("i", False), ("2", False), ("iii", False)}


def test_the_search_ladder_steps_down_and_says_why(spark):
    items = spark.createDataFrame([("a", "deep nets", None, False), ("b", "other", "about deep things", False), ("c", "deep", "deep", True)], "key string, title string, text string, deleted boolean")
    trash = spark.createDataFrame([("z",)], "key string")
    hits = [(r["key"], r["level"]) for r in search.ladder(items, trash, "deep").collect()]
    assert hits == [("b", "fulltext")]

    def broken(query):
        raise ValueError("there is no index")

    row = search.ladder(items, trash, "nets", semantic=broken).first()
    assert (row["key"], row["level"], row["degraded"]) == ("a", "keyword", ["semantic: there is no index", "fulltext: no hits"])
    near = lambda query: spark.createDataFrame([("c", 0.9), ("b", 0.8)], "key string, score double")
    assert [(r["key"], r["level"]) for r in search.ladder(items, trash, "x", semantic=near).collect()] == [("b", "semantic")]


def test_small_values(spark):
    from lectern.functions import values

    now = F.lit("2026-01-01 00:00:10").cast("timestamp")
    rows = spark.createDataFrame([("2026-01-01 00:00:09",), ("2026-01-01 00:00:00",), ("2026-01-01 00:00:11",), (None,)], "last string")
    assert [r[0] for r in rows.select(values.within_window(F.col("last").cast("timestamp"), now, 5000)).collect()] == [True, False, False, False]
    texts = spark.createDataFrame([('{"b": [" x ", ""], "a": 1.5}',), ("no json",), (None,)], "t string")
    assert [r[0] for r in texts.select(values.canonical_json("t")).collect()] == ['{"a":1.5,"b":["x",null]}', None, None]
    items = spark.createDataFrame([("a",), ("b",)], "key string")
    assert records.require_all(items, spark.createDataFrame([(0, " b "), (1, "")], "ord int, key string")).count() == 1
    with pytest.raises(ValueError, match="no items for: c"):
        records.require_all(items, spark.createDataFrame([(0, "c")], "ord int, key string"))
