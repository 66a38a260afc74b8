"""Metadata enrichment: service payloads to one record form, priority merge, status, managed text block.

Payload rows: key, source, rank (order of the request), status (HTTP), body (JSON text). Records: key,
source, rank and the FIELDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import identifiers as ids
from lectern.functions import text as tx

#: Priority of open-access places and of journal abbreviations.
OPEN_ACCESS_ORDER = ("unpaywall", "semanticscholar", "arxiv", "pmc")
ABBREVIATION_ORDER = ("crossref", "openalex", "pubmed")
#: The fields of the services' answers that are read.
PAYLOAD = (
    "id string, paperId string, doi string, is_retracted boolean, cited_by_count bigint, citationCount bigint, influentialCitationCount bigint, ids struct<pmcid:string>, "
    "primary_location struct<source:struct<display_name:string,abbreviated_title:string>>, openAccessPdf struct<url:string,license:string>, externalIds struct<DOI:string,PubMedCentral:string>, "
    "message struct<DOI:string,`container-title`:array<string>,`short-container-title`:array<string>,`updated-by`:array<struct<DOI:string,type:string,label:string>>,`update-to`:array<struct<DOI:string,type:string,label:string>>>, "
    "is_oa boolean, oa_status string, best_oa_location struct<url_for_pdf:string,url:string,url_for_landing_page:string,license:string>, "
    "summary struct<pubtype:array<string>,source:string,articleids:array<struct<idtype:string,value:string>>>"
)
FIELDS = ("doi", "cited_by", "citations", "influential", "retracted", "retraction_label", "retraction_doi", "journal", "abbreviation", "oa_url", "oa_license", "oa_status", "pmc_id")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def records(payloads: DataFrame) -> DataFrame:
    """Every answered payload in the common form; all services are read by one projection, without a row-wise function.

    Bodies are JSON, those of the preprint server an Atom feed of which the first entry counts.
    """
    feed = F.when(F.col("source") == "arxiv", arxiv_record(F.col("body")))
    rows = payloads.withColumn("p", F.when(F.col("source") != "arxiv", F.from_json("body", PAYLOAD))).withColumn("x", feed)
    p = lambda path: F.col(f"p.{path}")
    is_ = lambda *names: F.col("source").isin(*names)
    retraction = lambda c: F.get(F.filter(c, lambda e: e["type"] == "retraction"), F.lit(0))
    by, to = retraction(F.col("p.message.`updated-by`")), retraction(F.col("p.message.`update-to`"))
    withdrawn = F.get(F.filter(p("summary.pubtype"), lambda t: t.rlike("(?i)retracted publication")), F.lit(0))
    article_id = lambda kind: F.get(F.filter(p("summary.articleids"), lambda e: e["idtype"] == kind), F.lit(0))["value"]
    first_filled = lambda c: F.get(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    crossref_doi = ids.doi_reference(p("message.DOI"))
    hit = (
        F.when(is_("openalex"), _filled(p("id")).isNotNull()).when(is_("semanticscholar"), _filled(p("paperId")).isNotNull()).when(is_("crossref"), p("message").isNotNull())
        .when(is_("pubmed"), p("summary").isNotNull()).when(is_("arxiv"), F.col("x").isNotNull()).otherwise(F.col("p").isNotNull())
    )
    found = rows.where((F.col("status") == 200) & F.coalesce(hit, F.lit(False)))
    open_place = F.coalesce(_filled(p("best_oa_location.url_for_pdf")), _filled(p("best_oa_location.url")), _filled(p("best_oa_location.url_for_landing_page")))
    values = {
        "doi": F.when(is_("openalex", "unpaywall"), ids.doi_reference(p("doi"))).when(is_("semanticscholar"), ids.doi_reference(p("externalIds.DOI"))).when(is_("crossref"), crossref_doi).when(is_("pubmed"), ids.doi_reference(article_id("doi"))).when(is_("arxiv"), F.col("x.doi")),
        "cited_by": F.when(is_("openalex"), p("cited_by_count")),
        "citations": F.when(is_("semanticscholar"), p("citationCount")),
        "influential": F.when(is_("semanticscholar"), p("influentialCitationCount")),
        "retracted": F.coalesce(F.when(is_("openalex"), p("is_retracted")).when(is_("crossref"), by.isNotNull() | to.isNotNull()).when(is_("pubmed"), withdrawn.isNotNull()), F.lit(False)),
        "retraction_label": F.when(is_("crossref"), F.coalesce(_filled(by["label"]), _filled(by["type"]), _filled(to["label"]), _filled(to["type"]))).when(is_("pubmed"), withdrawn),
        "retraction_doi": F.when(is_("crossref"), F.when(by.isNotNull(), ids.doi_reference(by["DOI"])).when(to.isNotNull(), crossref_doi)),
        "journal": F.when(is_("openalex"), _filled(p("primary_location.source.display_name"))).when(is_("crossref"), first_filled(F.col("p.message.`container-title`"))),
        "abbreviation": F.when(is_("openalex"), _filled(p("primary_location.source.abbreviated_title"))).when(is_("crossref"), first_filled(F.col("p.message.`short-container-title`"))).when(is_("pubmed"), _filled(p("summary.source"))),
        "oa_url": F.when(is_("semanticscholar"), _filled(p("openAccessPdf.url"))).when(is_("unpaywall") & p("is_oa"), open_place).when(is_("arxiv"), F.col("x.pdf_url")),
        "oa_license": F.when(is_("semanticscholar"), _filled(p("openAccessPdf.license"))).when(is_("unpaywall") & p("is_oa"), _filled(p("best_oa_location.license"))).when(is_("arxiv"), F.col("x.license")),
        "oa_status": F.when(is_("unpaywall"), _filled(p("oa_status"))),
        "pmc_id": F.when(is_("openalex"), ids.pmc_id(p("ids.pmcid"))).when(is_("semanticscholar"), ids.pmc_id(p("externalIds.PubMedCentral"))).when(is_("pubmed"), ids.pmc_id(article_id("pmc"))),
    }
    return found.select("key", "source", "rank", *[values[f].alias(f) for f in FIELDS])


def arxiv_record(feed: Column) -> Column:
    """struct(id, title, doi, pdf_url, license) of the first entry of an Atom feed; null without one."""
    entry = F.regexp_extract(feed, "(?s)<entry>(.*?)</entry>", 1)
    tags = F.regexp_extract_all(entry, F.lit("<link\\b[^>]*>"), F.lit(0))
    attribute = lambda t, name: tx.decode_entities(F.regexp_extract(t, f'{name}\\s*=\\s*"([^"]*)"', 1))
    link = lambda test: F.nullif(attribute(F.element_at(F.filter(tags, test), -1), "href"), F.lit(""))
    found = lambda test: F.when(F.size(F.filter(tags, test)) > 0, link(test))
    address = F.nullif(F.trim(F.regexp_extract(entry, "<id>([^<]+)</id>", 1)), F.lit(""))
    title = tx.decode_entities(F.trim(F.regexp_replace(F.regexp_extract(entry, "(?s)<title>(.*?)</title>", 1), "\\s+", " ")))
    return F.when(
        address.isNotNull(),
        F.struct(
            F.regexp_replace(address, "^http:", "https:").alias("id"), title.alias("title"), ids.doi_reference(_filled(F.regexp_extract(entry, "<arxiv:doi[^>]*>([^<]*)</arxiv:doi>", 1))).alias("doi"),
            found(lambda t: (attribute(t, "rel") == "related") & (attribute(t, "title") == "pdf")).alias("pdf_url"), found(lambda t: attribute(t, "rel") == "license").alias("license"),
        ),
    )


def _first(value: Column, rank: Column) -> Column:
    """Value of least rank among rows that have one."""
    return F.min_by(value, F.when(value.isNotNull(), rank))


def merge(rows: DataFrame) -> DataFrame:
    """One row per key: the first value by request order, but open access and abbreviation by their own priorities.

    A combinable aggregate: no window, no list of unbounded length (a key has at most one row per source).
    """
    order = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("source"))
    rank = F.col("rank")
    places = F.when(F.col("oa_url").isNotNull() & F.col("source").isin(*OPEN_ACCESS_ORDER), order(OPEN_ACCESS_ORDER))
    abbreviations = F.when(F.col("abbreviation").isNotNull() & F.col("source").isin(*ABBREVIATION_ORDER), order(ABBREVIATION_ORDER))
    out = rows.groupBy("key").agg(
        _first(F.col("doi"), rank).alias("doi"), F.max("cited_by").alias("cited_by"), F.max("citations").alias("citations"), F.max("influential").alias("influential"), F.bool_or("retracted").alias("retracted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("retracted"), F.struct("rank", "source")))), lambda s: s["source"]).alias("retraction_sources"),
        _first(F.when(F.col("retracted"), F.col("retraction_label")), rank).alias("retraction_label"), _first(F.when(F.col("retracted"), F.col("retraction_doi")), rank).alias("retraction_doi"),
        F.min_by(F.struct("abbreviation", "source"), abbreviations).alias("a"), F.min_by(F.struct("source", "oa_url", "oa_license", "oa_status"), places).alias("o"), _first(F.col("pmc_id"), rank).alias("pmc_id"),
    )
    pmc = F.col("o").isNull() & F.col("pmc_id").isNotNull()
    return out.select(
        "key", "doi", "cited_by", "citations", "influential", "retracted", "retraction_sources", "retraction_label", "retraction_doi", F.col("a.abbreviation").alias("abbreviation"), F.col("a.source").alias("abbreviation_source"),
        F.when(pmc, "pmc").otherwise(F.col("o.source")).alias("oa_source"), F.when(pmc, ids.pmc_address(F.col("pmc_id"))).otherwise(F.col("o.oa_url")).alias("oa_url"), F.col("o.oa_license").alias("oa_license"),
        F.when(pmc, "pmc").otherwise(F.col("o.oa_status")).alias("oa_status"), "pmc_id",
    )


def outcomes(attempts: DataFrame) -> DataFrame:
    """attempts plus outcome: 200 is a hit where there is a record, 404 and an empty answer a miss, anything else failed."""
    return attempts.withColumn("outcome", F.when(F.col("status") == 404, "miss").when(F.col("status") != 200, "failed").when(F.col("hit"), "hit").otherwise("miss"))


def item_status(attempts: DataFrame) -> DataFrame:
    """(key, n_sources, n_hits, state): enriched when every source hit, needs-enrichment when none did, else partial."""
    t = outcomes(attempts).groupBy("key").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("outcome") == "hit").alias("n_hits"))
    return t.withColumn("state", F.when(F.col("n_hits") == 0, "needs-enrichment").when(F.col("n_hits") == F.col("n_sources"), "enriched").otherwise("partial"))


def block_lines(sep: str = " · ") -> Column:
    """Lines of the managed block of a merged record."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col
    optional = lambda value: F.coalesce(F.concat(F.lit(sep), value), F.lit(""))
    lines = F.array(
        line("cited-by: ", c("cited_by").cast("string"), f"{sep}openalex"), line("citations: ", c("citations").cast("string"), f"{sep}semanticscholar"),
        line("influential-citations: ", c("influential").cast("string"), f"{sep}semanticscholar"), line("journal-abbreviation: ", c("abbreviation"), optional(c("abbreviation_source"))),
        line("open-access: ", F.coalesce("oa_status", F.lit("yes")), sep, c("oa_url"), optional(c("oa_license")), sep, c("oa_source")),
        F.when(c("retracted"), line("retracted: yes", sep, F.array_join("retraction_sources", ", "), F.coalesce(F.concat(F.lit(f"{sep}notice "), c("retraction_doi")), F.lit("")))),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def apply_block(extra: Column, lines: Column, stamp: str, start: str = "<!-- enrichment:start -->", end: str = "<!-- enrichment:end -->") -> Column:
    """A text with its managed block replaced or appended; unchanged when the lines are the same or there are none.

    Applying a second time changes nothing, whatever the stamp.
    """
    text = F.coalesce(extra, F.lit(""))
    title = "enrichment · "
    block = F.concat(F.lit(f"{start}\n{title}{stamp}\n"), F.array_join(lines, "\n"), F.lit(f"\n{end}"))
    at = F.locate(start, text)
    stop = F.when(at > 0, F.locate(end, F.substring(text, at, F.length(text))))
    has = (at > 0) & (stop > 0)
    inner = F.substring(text, at + len(start), stop - 1 - len(start))
    existing = F.filter(F.transform(F.split(inner, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(title))
    replaced = F.concat(F.substring(text, F.lit(1), at - 1), block, F.substring(text, at + stop - 1 + len(end), F.length(text)))
    appended = F.when(F.trim(text) == "", block).otherwise(F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"), block))
    return F.when(F.size(lines) == 0, text).when(has & (existing == lines), text).when(has, replaced).otherwise(appended)


def write_set(merged: DataFrame, items: DataFrame, stamp: str) -> DataFrame:
    """(key, extra, abbreviation, tags, skipped, changed): what an item gets; an abbreviation it has is not overwritten, tags only grow.

    items: key, extra, abbreviation, tags, state.
    """
    m = merged.select("key", block_lines().alias("lines"), F.col("abbreviation").alias("found"), "retracted", F.col("oa_url").isNotNull().alias("open"))
    t = items.join(m, "key", "left")
    none = F.col("state") == "needs-enrichment"
    more = F.array_compact(F.array(F.when(none, F.lit("needs-enrichment")), F.when(~none & F.col("retracted"), F.lit("retracted")), F.when(~none & F.col("open"), F.lit("open-access"))))
    tags = F.concat("tags", F.filter(more, lambda x: ~F.array_contains("tags", x)))
    extra = F.when(none | F.col("lines").isNull(), F.col("extra")).otherwise(apply_block(F.col("extra"), F.col("lines"), stamp))
    had = F.trim(F.coalesce("abbreviation", F.lit("")))
    fills = ~none & (had == "") & F.col("found").isNotNull()
    out = t.select(
        "key", extra.alias("extra"), F.when(fills, F.col("found")).otherwise(F.col("abbreviation")).alias("abbreviation"), tags.alias("tags"),
        F.coalesce(~none & (had != "") & (had != F.col("found")), F.lit(False)).alias("skipped"), (~extra.eqNullSafe(F.col("extra")) | F.coalesce(fills, F.lit(False)) | (F.size(tags) > F.size("tags"))).alias("changed"),
    )
    return out
