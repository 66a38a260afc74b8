"""Highlight exchange: items and their annotations as XML elements, numbered and ordered by export request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.numbering import numbered_within
from lectern.storage import materialize

SECTIONS = ("References", "Locations", "KnowledgeItems", "Annotations", "EntityLinks")


#: Item types and their reference types; others are Unknown.
REFERENCE_TYPES = {
    "journalArticle": "JournalArticle", "conferencePaper": "ConferenceProceedings", "book": "Book", "bookSection": "Contribution", "thesis": "Thesis", "report": "Report",
    "webpage": "InternetDocument", "preprint": "UnpublishedWork", "manuscript": "Manuscript", "patent": "Patent", "newspaperArticle": "NewspaperArticle",
}


def reference_type(item_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REFERENCE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, item_type), F.lit("Unknown"))


def quads(position: Column) -> Column:
    """JSON list of quads, pages from 1, of a JSON position with pageIndex and rects of four numbers; null where that is not what it holds."""
    p = F.from_json(position, "pageIndex string, rects array<array<string>>")
    number = "^-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$"
    valid = p["pageIndex"].rlike("^[0-9]{1,9}$") & (F.size(p["rects"]) > 0) & F.forall(p["rects"], lambda r: (F.size(r) == 4) & F.forall(r, lambda x: F.coalesce(x.rlike(number), F.lit(False))))
    page = (p["pageIndex"].cast("int") + 1).cast("string")
    one = lambda r: F.concat(F.lit('{"PageIndex":'), page, F.lit(',"IsContainer":false,"X1":'), r[0], F.lit(',"Y1":'), r[1], F.lit(',"X2":'), r[2], F.lit(',"Y2":'), r[3], F.lit("}"))
    return F.when(valid, F.concat(F.lit("["), F.array_join(F.transform(p["rects"], one), ","), F.lit("]")))


def _element(tag: str, key: Column | None, fields: list[tuple[str, Column]], attributes: str = "") -> Column:
    head = F.lit(f"    <{tag}>") if key is None else F.concat(F.lit(f'    <{tag} id="'), key, F.lit('"'), F.lit(attributes) if attributes else F.lit(""), F.lit(">"))
    body = [F.concat(F.lit(f"      <{n}>"), tx.escape_xml(F.coalesce(v, F.lit(""))), F.lit(f"</{n}>")) for n, v in fields]
    return F.concat_ws("\n", head, *body, F.lit(f"    </{tag}>"))


def elements(items: DataFrame, annotations: DataFrame, prefix: str = "x-", type_col: str = "reference_type") -> DataFrame:
    """(export, section, k, xml): every element of the exports, in no order; section is its place in SECTIONS and k its number there.

    items: export, ord, key, title, year, doi, path and reference_type; those without a path are left out.
    annotations: key, pos, type, text, comment, color, label, position; those without usable quads are left
    out. Ids count within an export, without gaps: references and locations by ord, annotations by (ord, pos). An export of any size
    is numbered by range totals, over as many tasks as its rows need.
    """
    i = numbered_within(items.where(F.coalesce("path", F.lit("")) != ""), ["export"], [F.col("ord"), F.col("key")], "k")
    i = materialize(i.withColumn("n", (F.col("k") + 1).cast("string")), "exchange-items")
    ref, loc = F.concat(F.lit(f"{prefix}R"), "n"), F.concat(F.lit(f"{prefix}L"), "n")
    kind = F.concat(F.lit('    <Reference id="'), ref, F.lit('" ReferenceType="'), tx.escape_xml(F.col(type_col)), F.lit('">'))
    reference = F.concat_ws("\n", kind, *[F.concat(F.lit(f"      <{n}>"), tx.escape_xml(F.coalesce(F.col(c), F.lit(""))), F.lit(f"</{n}>")) for n, c in (("Title", "title"), ("Year", "year"), ("DOI", "doi"))], F.lit("    </Reference>"))
    address = F.to_json(F.struct(F.col("path").alias("UriString")))
    location = _element("Location", loc, [("ReferenceID", ref), ("Address", address)])
    a = annotations.withColumn("quads", quads(F.col("position"))).where("quads is not null").join(i.select("export", "ord", "key", "n"), "key")
    a = numbered_within(a, ["export"], [F.col("ord"), F.col("key"), F.col("pos")], "k").withColumn("m", (F.col("k") + 1).cast("string"))
    note, mark = F.concat(F.lit(f"{prefix}K"), "m"), F.concat(F.lit(f"{prefix}A"), "m")
    knowledge = _element("KnowledgeItem", note, [("CoreStatement", F.col("comment")), ("Text", F.col("text")), ("QuotationType", tx.quotation_type(F.col("color"), F.col("comment")).cast("string")), ("PageRange", F.col("label"))])
    annotation = _element("Annotation", mark, [("Quads", F.col("quads")), ("LocationID", loc)])
    link = _element("EntityLink", None, [("SourceID", note), ("TargetID", mark)])
    part = lambda s, x: F.struct(F.lit(SECTIONS.index(s)).alias("section"), x.alias("xml"))
    of = lambda rows, *parts: rows.select("export", F.explode(F.array(*parts)).alias("p"), "k").select("export", "p.section", "k", "p.xml")
    return of(i, part("References", reference), part("Locations", location)).unionByName(of(a, part("KnowledgeItems", knowledge), part("Annotations", annotation), part("EntityLinks", link)))


def lines(parts: DataFrame, root: str) -> DataFrame:
    """(export, section, k, xml) of the elements with the tags around sections and documents: ordered by section and k, each export is its XML document."""
    tags = [(-1, 0, f'<?xml version="1.0" encoding="utf-8"?>\n<{root} Version="6">'), (len(SECTIONS), 0, f"</{root}>")]
    tags += [t for s, name in enumerate(SECTIONS) for t in ((s, -1, f"  <{name}>"), (s, (1 << 62), f"  </{name}>"))]
    around = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).cast("long").alias("k"), F.lit(x).alias("xml")) for s, k, x in tags])
    frames = parts.select("export").distinct().select("export", F.explode(around).alias("t")).select("export", "t.*")
    return parts.withColumn("k", F.col("k").cast("long")).unionByName(frames)


def exchange(items: DataFrame, annotations: DataFrame, root: str, prefix: str = "x-", type_col: str = "reference_type") -> DataFrame:
    """(export, xml, n_items, n_annotations): one document a row, for exports that a row can hold; larger ones are written from ``lines``, in order."""
    rows = lines(materialize(elements(items, annotations, prefix, type_col), "exchange-elements"), root)
    count = lambda s: F.count_if((F.col("section") == SECTIONS.index(s)) & F.col("k").between(0, (1 << 62) - 1)).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("section", "k", "xml")))
    xml = F.concat(F.array_join(F.transform(ordered, lambda p: p["xml"]), "\n"), F.lit("\n"))
    return rows.groupBy("export").agg(xml.alias("xml"), count("References").alias("n_items"), count("Annotations").alias("n_annotations"))
