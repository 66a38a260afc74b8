"""Compiled plans applied to a library, and the operators and errors of saved searches."""

import pytest

from lectern.operators import stats
from lectern.plans import compiled, journal


def test_compiled_plans_are_applied(spark, tmp_path):
    folder = str(tmp_path / "library")
    journal.create(spark, folder, spark.createDataFrame([("A", 4, False, {"title": "old"}, ["x", "y"], []), ("B", 1, False, {}, ["x"], []), ("C", 1, False, {}, [], [])], journal.ITEM))
    records = spark.createDataFrame([(1, "book", {"title": "T", "version": "9", "note": None}, ["t", None], ["C1"]), (2, None, {}, None, None)], "ord int, item_type string, fields map<string,string>, tags array<string>, collections array<string>")
    files = spark.createDataFrame([(7, "D:\\in\\some_file.pdf", None, "doi", "10.1/x"), (8, "/in/b.txt", "Named", None, None)], "ord int, path string, title string, kind string, value string")
    plan = compiled.add_items(records).unionByName(compiled.import_files(files)).unionByName(compiled.rename_tag(journal.current(spark, folder), "x", "z"))
    assert compiled.summary(plan).first()["items"] == 8 and compiled.rename_tag(journal.current(spark, folder), "x", "x").count() == 0
    counts = journal.apply_plan(spark, folder, "p", plan)
    assert set(counts) == {"applied"}
    now = {r["key"]: r for r in journal.current(spark, folder).collect()}
    assert now["A"]["tags"] == ["y", "z"] and now["B"]["tags"] == ["z"] and now["A"]["version"] == 6 and now["C"]["version"] == 1
    assert now["@created:1"]["fields"] == {"itemType": "book", "title": "T"} and now["@created:1"]["tags"] == ["t"] and now["@created:1"]["collections"] == ["C1"]
    assert now["@created:2"]["fields"] == {"itemType": "document"}
    assert now["@created:7"]["fields"] == {"itemType": "document", "title": "some file", "DOI": "10.1/x"} and now["@created:8"]["fields"]["title"] == "Named"
    assert now["@created:7/file"]["fields"] == {"itemType": "attachment", "parentItem": "@created:7", "linkMode": "linked_file", "path": "D:\\in\\some_file.pdf", "contentType": "application/pdf"}


@pytest.mark.parametrize(
    "conditions,either,expected",
    [
        ([("title", "is", "ALPHA")], False, [1]), ([("title", "isNot", "alpha")], False, [2, 3]), ([("title", "doesNotContain", "a")], False, [3]), ([("title", "beginsWith", "be")], False, [2]),
        ([("tag", "contains", "re")], False, [1, 2]), ([("tag", "isNot", "red")], False, [2, 3]), ([("year", "isGreaterThan", "1999"), ("year", "isLessThan", "2001")], False, [2]), ([("year", "isGreaterThan", "x")], False, []),
        ([("title", "isBefore", "b"), ("year", "is", "2000")], True, [1, 2]), ([("title", "isAfter", "b")], False, [2]),
    ],
)
def test_saved_search_operators(spark, conditions, either, expected):
    items = spark.createDataFrame([(1, "alpha", ["red"], "1990"), (2, "beta", ["green", "blue"], "2000"), (3, None, None, None)], "key int, title string, tags array<string>, date string")
    searches = spark.createDataFrame([("s", *c, either) for c in conditions], "search string, field string, operator string, value string, any boolean")
    found = stats.saved_search(items, searches, "s", {"title": "title", "tag": "tags", "year": "date"})
    assert sorted(r["key"] for r in found.collect()) == expected


def test_saved_search_errors(spark):
    items = spark.createDataFrame([(1, "a")], "key int, title string")
    searches = spark.createDataFrame([("f", "nope", "is", "x", False), ("o", "title", "like", "x", False)], "search string, field string, operator string, value string, any boolean")
    for s in ("absent", "f", "o"):
        with pytest.raises(ValueError):
            stats.saved_search(items, searches, s, {"title": "title"})
