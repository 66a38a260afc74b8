"""Bibliographic records from the answers of identifier services, and the choice among them.

Answers: key, source (crossref, openlibrary, pubmed or translation), rank (order of the attempts), status
(HTTP, null for no answer), body (JSON text) and, for openlibrary, author_names (array of names looked up apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx

#: The fields of the services' answers that are read.
_WORK = (
    "title array<string>, DOI string, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, volume string, issue string, page string, publisher string, language string, "
    "URL string, ISSN array<string>, abstract string, author array<struct<given:string,family:string,name:string>>"
)
_BOOK = "title string, isbn_13 string, isbn_10 string, publish_date string, publishers array<string>, number_of_pages int, subjects array<string>"
_SUMMARY = "title string, source string, pubdate string, volume string, issue string, pages string, articleids array<struct<idtype:string,value:string>>, authors array<struct<name:string>>"
_ITEM = "itemType string, title string, date string, publicationTitle string, volume string, issue string, pages string, publisher string, language string, url string, ISSN string, ISBN string, DOI string, abstractNote string"
FIELDS = ("title", "date", "container", "volume", "issue", "pages", "publisher", "language", "url", "issn", "isbn", "doi", "abstract", "n_pages")
#: Fixed value: subjects of a book that become tags, the first ones.
TAGS = 8


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def date_of_parts(parts: Column) -> Column:
    """year, year-month or year-month-day of an array of up to three numbers, padded; null without a year."""
    return F.when(F.get(parts, F.lit(0)).isNotNull(), F.array_join(F.transform(F.slice(parts, 1, 3), lambda x, i: F.lpad(x.cast("string"), F.when(i == 0, 4).otherwise(2), F.lit("0"))), "-"))


def person(name: Column) -> Column:
    """struct(first, last) of a name: its last word is the surname, a single word is all of it."""
    parts = F.split(F.trim(name), "\\s+")
    return F.when(F.size(parts) > 1, F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ").alias("first"), F.element_at(parts, -1).alias("last"))).otherwise(F.struct(F.lit("").alias("first"), name.alias("last")))


def contributors(authors: Column) -> Column:
    """struct(first, last) of each author that has a family name or a name as a whole."""
    named = F.filter(authors, lambda a: F.coalesce(a["family"], a["name"], F.lit("")) != "")
    return F.transform(named, lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", F.struct(F.coalesce(a["given"], F.lit("")).alias("first"), a["family"].alias("last"))).otherwise(F.struct(F.lit("").alias("first"), a["name"].alias("last"))))


def service_records(answers: DataFrame) -> DataFrame:
    """(key, source, rank, item_type, FIELDS, tags, creators, reason) of every answer: reason says why it is no record, and is null for one.

    Each service is read by one projection of its JSON; no row-wise function. A book's tags are its first TAGS subjects.
    """
    rows = answers.withColumn("w", F.from_json(F.get_json_object("body", "$.message"), _WORK)).withColumn("b", F.from_json("body", _BOOK)).withColumn("s", F.from_json("body", _SUMMARY)).withColumn("i", F.from_json("body", _ITEM))
    is_ = lambda name: F.col("source") == name
    first = lambda c: F.get(c, F.lit(0))
    pick = lambda **by: F.coalesce(*[F.when(is_(name), c) for name, c in by.items()])
    w, b, s, i = (lambda f, p=p: F.col(f"{p}.{f}") for p in "wbsi")
    doi_entry = first(F.filter(s("articleids"), lambda e: e["idtype"] == "doi"))["value"]
    values = {
        "title": pick(crossref=first(w("title")), openlibrary=b("title"), pubmed=F.trim(F.regexp_replace(s("title"), "\\s+", " ")), translation=i("title")),
        "date": pick(crossref=date_of_parts(first(F.col("w.issued.`date-parts`"))), openlibrary=b("publish_date"), pubmed=s("pubdate"), translation=i("date")),
        "container": pick(crossref=first(F.col("w.`container-title`")), pubmed=s("source"), translation=i("publicationTitle")),
        "volume": pick(crossref=_filled(w("volume")), pubmed=s("volume"), translation=i("volume")),
        "issue": pick(crossref=_filled(w("issue")), pubmed=s("issue"), translation=i("issue")),
        "pages": pick(crossref=_filled(w("page")), pubmed=s("pages"), translation=i("pages")),
        "publisher": pick(crossref=_filled(w("publisher")), openlibrary=first(b("publishers")), translation=i("publisher")),
        "language": pick(crossref=_filled(w("language")), translation=i("language")),
        "url": pick(crossref=_filled(w("URL")), translation=i("url")),
        "issn": pick(crossref=first(w("ISSN")), translation=i("ISSN")),
        "isbn": pick(openlibrary=F.coalesce(b("isbn_13"), b("isbn_10")), translation=i("ISBN")),
        "doi": pick(crossref=w("DOI"), pubmed=doi_entry, translation=i("DOI")),
        "abstract": pick(crossref=_filled(tx.strip_markup(w("abstract"))), translation=i("abstractNote")),
        "n_pages": pick(openlibrary=b("number_of_pages").cast("string")),
    }
    people = F.col("author_names") if "author_names" in answers.columns else F.lit(None).cast("array<string>")
    named = lambda names: F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), person)
    creators = pick(crossref=contributors(w("author")), openlibrary=named(people), pubmed=named(F.transform(s("authors"), lambda a: a["name"])))
    tags = F.when(is_("openlibrary"), F.slice(b("subjects"), 1, TAGS))
    kind = F.when(is_("openlibrary"), "book").when(is_("translation"), F.coalesce(i("itemType"), F.lit("document"))).otherwise("journalArticle")
    reason = F.when(F.col("status").isNull(), "no answer").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.coalesce(values["title"], F.lit("")) == "", "no title")
    return rows.select("key", "source", "rank", kind.alias("item_type"), *[v.alias(n) for n, v in values.items()], tags.alias("tags"), creators.alias("creators"), reason.alias("reason"))


def resolve(answers: DataFrame) -> DataFrame:
    """One row per key: the record of the first attempt that gave one, and all attempts up to it in order, each with its reason.

    A key none of whose attempts gave a record has null fields. A combinable aggregate: a key has one row a source.
    """
    rows = service_records(answers)
    rest = [c for c in rows.columns if c not in ("key", "rank", "reason")]
    ok = F.col("reason").isNull()
    out = rows.groupBy("key").agg(
        F.min_by(F.when(ok, F.struct(*rest)), F.when(ok, F.col("rank"))).alias("r"), F.min(F.when(ok, F.col("rank"))).alias("taken"), F.array_sort(F.collect_list(F.struct("rank", "source", "reason"))).alias("attempts")
    )
    made = F.filter("attempts", lambda a: F.coalesce(a["rank"] <= F.col("taken"), F.lit(True)))
    return out.select("key", "r.*", F.transform(made, lambda a: F.concat(a["source"], F.lit(": "), F.coalesce(a["reason"], F.lit("ok")))).alias("attempts"))
