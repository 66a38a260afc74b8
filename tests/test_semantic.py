import pytest

from lectern.operators import semantic


def test_incremental_index_states(spark, tmp_path):
    folder, model = str(tmp_path / "index"), semantic.character_embedder(16)

    def state(rows):
        df = spark.createDataFrame(rows, "key string, version long, text string")
        return df.select("key", "text"), df.select("key", "version")

    rows = [(k, i + 1, f"{k} " * 300) for i, k in enumerate("abcde")]
    counts = lambda d: (d["embedded"], d["skipped"], d["removed"])
    assert counts(semantic.update(folder, *state(rows), model)) == (5, 0, 0)
    assert counts(semantic.update(folder, *state(rows), model)) == (0, 0, 0)
    rows[0] = ("a", 9, rows[0][2])  # a newer version of the same text
    assert counts(semantic.update(folder, *state(rows), model)) == (0, 1, 0)
    rows[1] = ("b", 10, "z " * 300)
    assert counts(semantic.update(folder, *state(rows), model)) == (1, 0, 0)
    rows[2] = ("c", 11, " ")
    assert counts(semantic.update(folder, *state(rows[:4]), model)) == (0, 0, 2)  # e vanished, c is empty now
    found = semantic.passages(spark, folder).collect()
    texts = {k: t for k, _, t in rows}
    assert {r["key"] for r in found} == {"a", "b", "d"} and all(texts[r["key"]][r["char_start"] : r["char_end"]] == r["text"] for r in found)
    hits = semantic.search(spark, folder, "z z z", model, 2, spark.createDataFrame([("b", "Title")], "key string, title string")).collect()
    assert {(r["key"], r["title"]) for r in hits} == {("b", "Title")} and all(-1 <= r["score"] <= 1 for r in hits)
    assert counts(semantic.update(folder, *state(rows[:2]), semantic.character_embedder(32))) == (2, 0, 0)  # another length: anew
    assert {r["key"] for r in semantic.passages(spark, folder).collect()} == {"a", "b"}
    for query, embedder in (("  ", semantic.character_embedder(32)), ("x", model)):
        with pytest.raises(ValueError):
            semantic.search(spark, folder, query, embedder)
    with pytest.raises(ValueError):
        semantic.search(spark, str(tmp_path / "none"), "x", model)


def test_labels_compaction_and_vacuum(spark, tmp_path):
    folder, model = str(tmp_path / "labelled"), semantic.character_embedder(16)
    schema = "key string, version long, text string, pages int, labels array<string>"

    def put(*rows, **more):
        df = spark.createDataFrame(rows, schema)
        return semantic.update(folder, df.drop("version"), df.select("key", "version"), model, max_tokens=8, **more)

    text = "first page text here\fsecond page text here\fthird page text here"
    a, b, c = ("a", 1, text, 3, ["", "477", "478"]), ("b", 2, "words " * 40, 4, None), ("c", 3, "words " * 20, None, None)
    put(a, b, c)
    labels = lambda: {(r["key"], r["char_start"]): (r["page_label"], r["estimated"]) for r in semantic.passages(spark, folder).collect()}
    first = labels()
    assert {v for (k, _), v in first.items() if k == "b"} <= {(str(p), True) for p in (1, 2, 3, 4)} and {v for (k, _), v in first.items() if k == "c"} == {(None, False)}
    for (key, start), v in first.items():
        if key == "a":
            assert v == (["1", "477", "478"][text[:start].count("\f")], False)
    assert put(a, b, c)["embedded"] == 0 and labels() == first  # an empty update keeps labels and alignment
    one = semantic.status(spark, folder).first()
    assert (one["items"], one["runs"], one["watermark"], one["degraded"]) == (3, 2, 3, ["no-separators: 2"]) and one["stored_at"] is not None
    put(a, ("b", 4, text + " more", 3, None), ("d", 5, "new " * 9, None, None))
    before = labels()
    assert {k for k, _ in before} == {"a", "b", "d"}
    search = lambda: [(r["key"], r["idx"], r["page_label"], round(r["score"], 6)) for r in semantic.search(spark, folder, "page text", model, 5).collect()]
    hits = search()
    reader = semantic.passages(spark, folder)
    assert semantic.compact(spark, folder, model) == 4 and labels() == before and search() == hits
    assert reader.count() == len(before)  # a reader of the state before goes on
    assert semantic.vacuum(spark, folder) == [f"{t}/run={r}" for t in ("chunks", "items") for r in (1, 2, 3)] and labels() == before and search() == hits
    put(("a", 6, "other words", None, None), ("b", 4, text + " more", 3, None), ("d", 5, "new " * 9, None, None), compact_after=2)  # compacts by itself
    meta = semantic.latest(spark, folder)
    assert meta["runs"] == [6] and {k for k, _ in labels()} == {"a", "b", "d"} and semantic.status(spark, folder).first()["chunks"] == len(labels())
    none = semantic.status(spark, str(tmp_path / "none")).first()
    assert (none["items"], none["degraded"]) == (0, ["there is no index"])
