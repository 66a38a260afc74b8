import pytest

from lectern.operators import identify, tokens
from lectern.streaming import updates


def test_streamed_index_keeps_the_newest_version(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("source", "index", "checkpoint"))
    rows = [("a", 1, "first text of a"), ("b", 1, "text of b"), ("a", 2, "second text of a")]
    spark.createDataFrame(rows, updates.SCHEMA).coalesce(1).write.parquet(source)
    updates.maintain(spark, source, folder, checkpoint).awaitTermination()
    assert {(r["key"], r["version"], r["text"]) for r in updates.current(spark, folder).collect()} == {("a", 2, "second text of a"), ("b", 1, "text of b")}
    spark.createDataFrame([("b", 2, "new text of b"), ("c", 1, "c")], updates.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    updates.maintain(spark, source, folder, checkpoint).awaitTermination()
    assert {(r["key"], r["text"]) for r in updates.current(spark, folder).collect()} == {("a", "second text of a"), ("b", "new text of b"), ("c", "c")}


def test_word_pieces_and_unigrams():
    vocabulary = {t: k for k, t in enumerate(["un", "##able", "##a", "a"])}
    assert tokens.word_pieces("unable", vocabulary) == ["un", "##able"] and tokens.word_pieces("unax", vocabulary) == ["[UNK]"]
    scores = {"ab": -1.0, "a": -2.0, "bc": -0.5, "c": -5.0, "b": -4.0}
    assert tokens.unigram_pieces("abc", scores) == ["a", "bc"]  # the greedy ab, c is less likely
    assert tokens.unigram_pieces("a?c", scores) == ["a", "?", "c"] and tokens.unigram_pieces("", scores) == []


def test_word_piece_encoding(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "deep", "learn", "##ing", ".", "机", "器"]
    df = spark.createDataFrame([("1", "Deep learning. 机器 xyz"), ("2", None)], "key string, text string")
    got = {r["key"]: (r["ids"], r["n_tokens"], r["n_unknown"]) for r in tokens.encode_word_pieces(df, vocabulary).collect()}
    assert got == {"1": ([2, 4, 5, 6, 7, 8, 9, 1, 3], 7, 1), "2": ([2, 3], 0, 0)}
    with pytest.raises(ValueError):
        tokens.encode_word_pieces(df, ["a"])


def test_identification_stages(spark):
    files = [
        ("text", "x.pdf", "see 10.1000/abc. and"), ("xmp", "x.pdf", '<dc:title>\n<rdf:Alt><rdf:li xml:lang="x">A title</rdf:li></rdf:Alt></dc:title> prism:doi="10.77"'),
        ("title", "x.pdf", "/Title (Graph kernels in practice) /Author (Smith) /CreationDate (D:20200102"), ("name", "graph_kernels-in practice.pdf", "nothing"), ("none", "x.pdf", "nothing"),
        ("hex", "x.pdf", "/Title <FEFF004700720061007000680020006B00650072006E0065006C007300200069006E0020007000720061006300740069006300650073>"),
    ]
    candidates = [(k, p, t, d) for k in ("title", "name", "hex", "none") for p, t, d in ((0, "Other matters entirely", "10.1/z"), (1, "Graph Kernels in Practice", "https://doi.org/10.1/g"))]
    got = identify.identify(spark.createDataFrame(files, "key string, file_name string, text string"), spark.createDataFrame(candidates, "key string, pos int, title string, doi string"))
    assert {r["key"]: (r["level"], r["value"]) for r in got.collect()} == {"text": (1, "10.1000/abc"), "xmp": (2, "10.77"), "title": (3, "10.1/g"), "hex": (3, "10.1/g"), "name": (4, "10.1/g"), "none": (0, None)}
