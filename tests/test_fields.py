import io
import zipfile

from lectern.operators import fields, records

RUN = '<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{}</w:t></w:r>'


def texts(xml):
    return "".join(fields._TEXT.findall(xml))


def test_placeholder_inside_one_run_keeps_the_text_around_it():
    xml = "<w:p>" + RUN.format("see {{cite:a}} &amp; {{cite:b}} end") + "<w:r><w:t>tail</w:t></w:r></w:p><w:p/>"
    out, n = fields.inject(xml, {"a": ("CODE a", "(A)"), "b": ("CODE b", "(B)")})
    assert n == 2 and texts(out) == "see (A) &amp; (B) endtail" and out.count("<w:b/>") == 3 + 10 and out.count("instrText xml") == 2
    assert out.index("CODE a") < out.index("CODE b") and out.endswith("<w:p/>")


def test_placeholder_over_several_runs():
    xml = "<w:p><w:pPr/>" + RUN.format("x {{ci") + RUN.format("te:") + "<w:bookmarkEnd/><w:r><w:t>a}} y</w:t></w:r></w:p>"
    out, n = fields.inject(xml, {"a": ("C", "(A)")})
    assert n == 1 and texts(out) == "x (A) y" and out.startswith("<w:p><w:pPr/>")


def test_what_stays_as_it_is():
    for xml in ("<w:p>" + RUN.format("{{cite:none}}") + "</w:p>", "<w:p><w:r><w:t>{{cite:a}}</w:t><w:drawing/></w:r></w:p>", "<w:p/>", ""):
        assert fields.inject(xml, {"a": ("C", "(A)")}) == (xml, 0)


def test_documents_in_a_package(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p>" + RUN.format("{{cite:a}} and {{cite:zz}}") + "</w:p>")
        z.writestr("other.bin", b"\0")
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    parts = records.packed_parts(spark.read.format("binaryFile").load(str(tmp_path)), "word/document\\.xml")
    documents = parts.selectExpr("'x' AS file", "CAST(content AS STRING) AS xml")
    mapping = spark.createDataFrame([("x", "a", "CODE", "(A 2020)"), ("x", "unused", "C", "U")], "file string, name string, code string, shown string")
    got = fields.inject_fields(documents, mapping).first()
    assert got["replaced"] == 1 and texts(got["xml"]) == "(A 2020) and {{cite:zz}}"
    report = records.placeholder_report(records.placeholders(records.paragraphs(documents)), mapping)
    assert {(r["name"], r["state"]) for r in report.collect()} == {("a", "ok"), ("zz", "unmapped"), ("unused", "unused")}
