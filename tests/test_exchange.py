import xml.etree.ElementTree as ET

from lectern.operators.exchange import exchange


def test_exchange_document(spark):
    items = [("e", 2, "B", "Second & last", "2020", None, "C:\\b.pdf", "Book"), ("e", 1, "A", 'First "one"', None, "10.1/a", "/a.pdf", "JournalArticle"), ("e", 3, "C", "no file", "1", None, None, "Book"), ("f", 1, "D", "alone", "1", None, "/d.pdf", "Unknown")]
    position = '{"pageIndex":2,"rects":[[1,2.5,3,4],[5,6,7,8]]}'
    marks = [("A", 1, "highlight", "text <1>", None, "#ffd401", "iv", position), ("A", 0, "note", "t", "mine", "#ffd401", None, position), ("B", 0, "highlight", "x", None, None, "1", '{"pageIndex":0,"rects":[]}'), ("B", 1, "highlight", "x", None, None, "1", "{}"), ("B", 2, "highlight", "last", "", "#2ea8e5", "9", position)]
    i = spark.createDataFrame(items, "export string, ord int, key string, title string, year string, doi string, path string, reference_type string")
    a = spark.createDataFrame(marks, "key string, pos int, type string, text string, comment string, color string, label string, position string")
    got = {r["export"]: r for r in exchange(i, a, "ExchangeData").collect()}
    assert {k: (r["n_items"], r["n_annotations"]) for k, r in got.items()} == {"e": (2, 3), "f": (1, 0)}
    root = ET.fromstring(got["e"]["xml"].encode())
    assert [(r.get("id"), r.get("ReferenceType"), r.findtext("Title"), r.findtext("Year"), r.findtext("DOI")) for r in root.find("References")] == [("x-R1", "JournalArticle", 'First "one"', "", "10.1/a"), ("x-R2", "Book", "Second & last", "2020", "")]
    assert [r.findtext("Address") for r in root.find("Locations")] == ['{"UriString":"/a.pdf"}', '{"UriString":"C:\\\\b.pdf"}']
    assert [(k.get("id"), k.findtext("Text"), k.findtext("CoreStatement"), k.findtext("QuotationType"), k.findtext("PageRange")) for k in root.find("KnowledgeItems")] == [
        ("x-K1", "t", "mine", "4", ""), ("x-K2", "text <1>", "", "5", "iv"), ("x-K3", "last", "", "1", "9"),
    ]
    first = root.find("Annotations")[0]
    assert first.findtext("Quads") == '[{"PageIndex":3,"IsContainer":false,"X1":1,"Y1":2.5,"X2":3,"Y2":4},{"PageIndex":3,"IsContainer":false,"X1":5,"Y1":6,"X2":7,"Y2":8}]'
    assert [(x.findtext("SourceID"), x.findtext("TargetID")) for x in root.find("EntityLinks")] == [(f"x-K{k}", f"x-A{k}") for k in (1, 2, 3)]
