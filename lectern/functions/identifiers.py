"""Identifiers: normal forms, recognition and extraction, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of identifiers in running text.
DOI_IN_TEXT = "10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+"
ARXIV_IN_TEXT = "(?i)arXiv:\\s*(\\d{4}\\.\\d{4,5})(?:v\\d+)?"
ISBN_IN_TEXT = "\\bISBN(?:-1[03])?:?\\s*((?:97[89][-\\s]?)?\\d[-\\d\\s]{9,16}[\\dXx])\\b"
DOI_ADDRESS = "(?i)^https?://(dx\\.)?doi\\.org/"
DOI_LABEL = "(?i)^doi:\\s*"
#: A label, an address and a body; what a DOI begins with.
LABELLED = "(?is)^(?:(doi|isbn|pmid)(?:\\s*:|\\s)\\s*)?(\\S*?doi\\.org/)?(.*)$"
REGISTRANT = "^10\\.[0-9]{4,9}/\\S+$"


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def doi_key(c: Column) -> Column:
    """Comparison form of a DOI: without address or label, in lower case; null when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), DOI_ADDRESS, ""), DOI_LABEL, "")
    return _filled(F.lower(F.trim(bare)))


def doi_reference(c: Column) -> Column:
    """A DOI as metadata services are asked for it: like doi_key in its own case, and without final stops."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), DOI_ADDRESS, ""), DOI_LABEL, "")
    return _filled(F.trim(F.regexp_replace(bare, "[.,;]+$", "")))


def isbn_key(c: Column) -> Column:
    return _filled(F.upper(F.regexp_replace(c, "[^0-9Xx]", "")))


def pmid_key(c: Column) -> Column:
    return _filled(F.regexp_replace(c, "[^0-9]", ""))


def strong_key(doi: Column, isbn: Column, pmid: Column) -> Column:
    """'doi:x', 'isbn:x' or 'pmid:x': an item has one strong key, of the first identifier that it has."""
    tagged = lambda name, key: F.concat(F.lit(f"{name}:"), key)
    return F.coalesce(tagged("doi", doi_key(doi)), tagged("isbn", isbn_key(isbn)), tagged("pmid", pmid_key(pmid)))


def pmc_id(c: Column) -> Column:
    """The 3 to 9 digits of a PubMed Central id, null without them."""
    return _filled(F.regexp_extract(F.regexp_replace(c, "(?i)^PMC", " "), "(\\d{3,9})", 1))


def pmc_address(pmc: Column) -> Column:
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), pmc, F.lit("/"))


def parsed_identifier(c: Column) -> Column:
    """struct(kind, value) of a whole string: its label or address names the kind, else the shape of what is left; null fields where nothing fits.

    A string is read as an optional label (doi, isbn or pmid, with a colon or blank), an optional address of the DOI resolver, and a body. A body
    of digits is told by their number: up to 8 make a PMID, 10 (the last may be an x) or 13 an ISBN; a registrant and a slash make a DOI.
    """
    part = lambda k: F.regexp_extract(F.trim(c), LABELLED, k)
    label, address, body = F.lower(part(1)), part(2), F.trim(part(3))
    compact = F.translate(body, "- \t\n", "")
    digits, n = F.regexp_count(compact, F.lit("[0-9]")), F.length(compact)
    checked = (n == 10) & (digits == 9) & F.lower(compact).endswith("x")
    shape = (
        F.when((digits == n) & (n == F.length(body)) & n.between(1, 8), "pmid").when(((digits == n) & n.isin(10, 13)) | checked, "isbn")
        .when(F.regexp_extract(body, REGISTRANT, 0) != "", "doi")
    )
    kind = F.when(label != "", label).when(address != "", "doi").otherwise(shape)
    return F.struct(kind.alias("kind"), F.when(kind == "isbn", compact).when(kind.isNotNull(), body).alias("value"))


def identifier_kind(c: Column) -> Column:
    return parsed_identifier(c)["kind"]


def identifier_value(c: Column) -> Column:
    return parsed_identifier(c)["value"]


def found_identifier(c: Column) -> Column:
    """struct(kind, value) of the first DOI in a text, else arXiv id, else ISBN; null fields without any."""
    doi = _filled(F.regexp_replace(F.regexp_extract(c, DOI_IN_TEXT, 0), "[.,;:]+$", ""))
    arxiv = _filled(F.regexp_extract(c, ARXIV_IN_TEXT, 1))
    digits = F.regexp_replace(F.regexp_extract(c, ISBN_IN_TEXT, 1), "[^0-9Xx]", "")
    isbn = F.when(F.length(digits) >= 10, digits)
    kind = F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(isbn.isNotNull(), "isbn")
    return F.struct(kind.alias("kind"), F.coalesce(doi, arxiv, isbn).alias("value"))
