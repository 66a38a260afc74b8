"""Text functions as Column expressions: they stay inside generated code and cost no Python."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _folding() -> tuple[str, str]:
    """(characters, plain characters): every single character whose compatibility decomposition is one ASCII letter or digit and marks."""
    source, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x2070, 0x20A0), 0xAA, 0xB2, 0xB3, 0xB9, 0xBA):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code) and base.isascii():
            source.append(chr(code)), plain.append(base)
    return "".join(source), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without diacritics: Latin and full-width letters become plain ones, combining marks go."""
    source, plain = _folding()
    return F.lower(F.regexp_replace(F.translate(c, source, plain), "[\\u0300-\\u036f]", ""))


@functools.cache
def _unmarking() -> tuple[str, str]:
    """(characters, plain characters): every character that is one other one in canonical decomposition without marks; then the marks, for which there is none."""
    source, plain, marks = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if not base:
            marks.append(chr(code))
        elif len(base) == 1 and base != chr(code):
            source.append(chr(code)), plain.append(base)
    return "".join(source + marks), "".join(plain)


def unmarked(c: Column) -> Column:
    """Lower case without the marks of any script: canonical decomposition alone, so that full-width and raised letters stay what they are."""
    return F.lower(F.translate(c, *_unmarking()))


def squeeze(c: Column) -> Column:
    """Trimmed, with each stretch of white space as one space; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")


def normalize_title(c: Column) -> Column:
    """Comparison form of a title: folded, only letters, digits and CJK, single spaces, without one leading article."""
    words = F.trim(F.regexp_replace(fold(c), "[^a-z0-9\\u4e00-\\u9fff]+", " "))
    return F.trim(F.regexp_replace(words, "^(the|a|an) +", ""))


def normalize_surname(c: Column) -> Column:
    """Comparison form of a surname: folded, only letters, digits and CJK, nothing between them."""
    return F.regexp_replace(fold(c), "[^a-z0-9\\u4e00-\\u9fff]+", "")


def surname(last: Column, name: Column) -> Column:
    """Comparison form of the family name, else of the last word of a single-field name; null when neither is there."""
    last, name = F.nullif(F.trim(last), F.lit("")), F.nullif(F.trim(name), F.lit(""))
    return normalize_surname(F.coalesce(last, F.element_at(F.split(name, "\\s+"), -1)))


def display_name(last: Column, first: Column, name: Column) -> Column:
    """'name', or 'last, first'; the empty string when there is nothing to show."""
    last, first = F.coalesce(last, F.lit("")), F.coalesce(first, F.lit(""))
    comma = F.when((last != "") & (first != ""), ", ").otherwise("")
    return F.coalesce(name, F.trim(F.concat(last, comma, first)))


def first_year(c: Column) -> Column:
    """The first run of four digits as a number, null without one."""
    return F.nullif(F.regexp_extract(c, "(\\d{4})", 1), F.lit("")).cast("int")


def usable_title(c: Column) -> Column:
    """Whether a title is specific enough to look a record up by it."""
    t = F.trim(c)
    # fixed values: titles that name no work
    junk = ("abstract", "untitled", "document", "document1", "main", "full text", "fulltext", "microsoft word", "pdf", "article", "paper", "manuscript", "no title", "title")
    short_word = ~t.rlike("\\s") & (F.length(t) < 12)
    return F.coalesce((F.length(t) >= 6) & ~F.lower(t).isin(*junk) & ~t.rlike("^[\\d\\W_]+$") & ~short_word, F.lit(False))


def title_for_lookup(c: Column) -> Column:
    """The weaker test of the metadata services: six characters and a space."""
    t = F.trim(c)
    return F.coalesce((F.length(t) >= 6) & t.rlike("\\s"), F.lit(False))


def title_from_file_name(c: Column) -> Column:
    """File name without .pdf, with _ and - read as spaces; the name itself when nothing is left."""
    t = squeeze(F.regexp_replace(F.regexp_replace(c, "(?i)\\.pdf$", ""), "[_-]+", " "))
    return F.coalesce(F.nullif(t, F.lit("")), c)


def decode_entities(c: Column) -> Column:
    """The five XML references and &#39;, the ampersand last so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def decode_numeric(c: Column) -> Column:
    """Decimal and hexadecimal references to characters outside markup (&#38; and &#60; become the named ones, which are decoded last); those beyond Unicode stay.

    A text is cut at its references, so each is decoded once.
    """
    found = F.regexp_extract_all(c, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0))
    between = F.split(c, "&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
    code = lambda r: F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.regexp_extract(r, "[xX]([0-9A-Fa-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    utf32 = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    char = lambda r: F.when(code(r) == 38, "&amp;").when(code(r) == 60, "&lt;").when((code(r) == 0) | (code(r) > 0x10FFFF) | code(r).between(0xD800, 0xDFFF), r).otherwise(utf32(code(r)))
    decoded = F.transform(between, lambda p, k: F.concat(p, F.coalesce(char(F.get(found, k)), F.lit(""))))
    return F.when(c.contains("&#"), F.array_join(decoded, "")).otherwise(c)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_xml(c: Column) -> Column:
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))


def note_html(c: Column) -> Column:
    """Text that holds markup stays; other text becomes one escaped paragraph with line breaks."""
    t = F.trim(c)
    return F.when(t.rlike("(?is)<[a-z].*>"), t).otherwise(F.concat(F.lit("<p>"), F.replace(escape_html(t), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))


def plain_text(c: Column) -> Column:
    """Markup removed, white space squeezed, references decoded (numeric ones too), trimmed."""
    return F.trim(decode_entities(decode_numeric(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " "))))


def strip_markup(c: Column) -> Column:
    """Abstract markup read as spaces; null for null or empty text."""
    return F.when(c != "", F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "\\s+", " ")))


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def content_type(path: Column) -> Column:
    """MIME type by extension, application/octet-stream for others."""
    # fixed values: extensions and their types
    types = {
        ".pdf": "application/pdf", ".epub": "application/epub+zip", ".html": "text/html", ".htm": "text/html", ".txt": "text/plain", ".md": "text/markdown",
        ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".djvu": "image/vnd.djvu",
    }
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, "[^/](\\.[^./]*)$", 1))), F.lit("application/octet-stream"))


def file_path(url: Column) -> Column:
    """Path of a file:// address, percent-decoded; the slash before a drive letter goes."""
    path = F.url_decode(F.replace(F.substring(url, 8, 1 << 20), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^/(?=[A-Za-z]:)", "")


def is_loopback(url: Column) -> Column:
    """Whether an address points at this machine."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin("127.0.0.1", "localhost", "::1", "[::1]"), F.lit(False))


def masked_key(c: Column) -> Column:
    """A credential as it may be shown: its first four characters and its length."""
    t = F.trim(c)
    shown = F.concat(F.substring(t, 1, 4), F.lit("... (length "), F.length(t).cast("string"), F.lit(")"))
    return F.when(F.length(t) == 0, "(empty)").when(F.length(t) < 8, F.concat(F.lit("(set, length "), F.length(t).cast("string"), F.lit(")"))).otherwise(shown)


def citation_key(extra: Column) -> Column:
    """Key of a 'Citation Key: x' line, null without one."""
    return F.nullif(F.regexp_extract(extra, "(?im)^\\s*Citation Key:\\s*(\\S+)\\s*$", 1), F.lit(""))


def annotation_link(scheme: str, attachment: Column, annotation: Column, page: Column) -> Column:
    """Link that opens an attachment at an annotation, with the page label where there is one."""
    page_part = F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit("page="), F.url_encode(page), F.lit("&"))).otherwise("")
    return F.concat(F.lit(f"{scheme}://open-pdf/library/items/"), attachment, F.lit("?"), page_part, F.lit("annotation="), F.url_encode(annotation))


def reveal_link(scheme: str, key: Column, page: Column, annotation: Column, group: Column) -> Column:
    """Link that selects an item, or opens it at a page from 1 and an annotation; null for a key that is none or a page below 1."""
    library = F.coalesce(F.concat(F.lit("groups/"), group), F.lit("library"))
    note = F.coalesce(F.concat(F.lit("&annotation="), F.url_encode(annotation)), F.lit(""))
    opened = F.concat(F.lit(f"{scheme}://open-pdf/"), library, F.lit("/items/"), key, F.lit("?page="), page.cast("string"), note)
    selected = F.concat(F.lit(f"{scheme}://select/"), library, F.lit("/items/"), key)
    return F.when(key.rlike("^[A-Za-z0-9]{1,32}$"), F.when(page.isNull(), selected).when(page >= 1, opened))


def sort_index(page_index: Column, top: Column) -> Column:
    """Reading-order key of an annotation: page, offset and top, five, six and five digits."""
    five = lambda c: F.lpad(F.substring(F.greatest(F.lit(0), F.coalesce(F.floor(c), F.lit(0))).cast("string"), 1, 5), 5, "0")
    return F.concat_ws("|", five(page_index), F.lit("000000"), five(top))


def nearest_type(color: Column, comment: Column, palette: dict[int, str], without_comment: tuple[int, ...], with_comment: tuple[int, ...]) -> Column:
    """Number of the palette colour nearest to #rrggbb; a comment restricts the choice; the first of equals wins."""
    valid = F.when(F.length(color) == 7, F.lower(color)).otherwise("#2ea8e5")
    part = lambda c, k: F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("int")

    def nearest(numbers: tuple[int, ...]) -> Column:
        options = [
            F.struct(sum((F.pow(part(valid, k) - int(palette[n][1 + 2 * k : 3 + 2 * k], 16), 2) for k in range(3)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(numbers)
        ]
        return F.array_min(F.array(*options)).getField("n")

    return F.when(F.coalesce(comment, F.lit("")) != "", nearest(with_comment)).otherwise(nearest(without_comment))


#: The quotation types of the highlight exchange and their colours; those that keep a comment.
QUOTATION_COLORS = {1: "#2ea8e5", 2: "#a6507b", 3: "#5fb236", 4: "#ff8c19", 5: "#ffd400", 6: "#ff6666"}


def quotation_type(color: Column, comment: Column) -> Column:
    """Quotation type of nearest colour; a comment allows only types that keep it."""
    return nearest_type(color, comment, QUOTATION_COLORS, (1, 3, 4, 5, 6), (1, 3, 4))


def joined_citations(texts: Column) -> Column:
    """Citation texts, each freed of one pair of outer brackets, as one bracketed list; empty without any."""
    clean = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    clean = F.transform(clean, lambda t: F.trim(F.regexp_replace(t, "^\\((.*)\\)$", "$1")))
    return F.when(F.size(clean) == 0, "").otherwise(F.concat(F.lit("("), F.array_join(clean, "; "), F.lit(")")))


def error_class(status: Column) -> Column:
    """What an HTTP status means for a write session."""
    # fixed values: statuses and their classes
    return (
        F.when(status == 401, "write-unauthorized").when(status == 403, "local-api-disabled").when(status == 412, "version-conflict").when(status == 428, "missing-server-id")
        .when(status == 429, "rate-limited").otherwise("http-error")
    )


def pdf_date(c: Column) -> Column:
    """yyyy, yyyy-mm or yyyy-mm-dd from a compact or ISO date; null for others."""
    t = F.trim(c)
    groups = [F.nullif(F.regexp_extract(t, "^(\\d{4})(\\d{2})?(\\d{2})?$", k), F.lit("")) for k in (1, 2, 3)]
    return F.coalesce(F.nullif(F.concat_ws("-", *groups), F.lit("")), F.nullif(F.regexp_extract(t, "^(\\d{4}-\\d{2}-\\d{2})", 1), F.lit("")))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.when(c.isNotNull(), F.lpad(c.cast("string"), 2, "0"))
    return F.when(year.isNotNull(), F.concat_ws("-", year.cast("string"), two(month), two(day)))


def name_parts(c: Column) -> Column:
    """struct(last, first) of 'Last, First' or 'First Middle Last'; first is null for a single word."""
    t = F.trim(c)
    pieces, words = F.split(t, ","), F.split(t, "\\s+")
    comma = F.struct(F.trim(pieces[0]).alias("last"), F.trim(pieces[1]).alias("first"))
    spaced = F.struct(F.element_at(words, -1).alias("last"), F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).alias("first"))
    return F.when(t.contains(","), comma).otherwise(spaced)


def completeness(title: Column, doi: Column, year: Column, creators: Column) -> Column:
    """How many of title, DOI, year and creators are there."""
    there = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return there(title != "") + there(doi != "") + there(year.isNotNull()) + there(creators > 0)
