"""Identification of documents in stages: text, embedded metadata, file name, best title among candidates."""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import identifiers as ids
from lectern.functions import text as tx
from lectern.functions.similarity import jaro_winkler_udf


_PACKET = re.compile(r"<(?:\w+:)?RDF[\s>].*?</(?:\w+:)?RDF\s*>", re.S)
_DATE = re.compile(r"(?:D:)?([0-9]{4})(?:-?([0-9]{2}))?(?:-?([0-9]{2}))?")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _local(name: str) -> str:
    return name.rpartition("}")[2].lower()


def packet_fields(packet: str) -> dict[str, list[str]]:
    """Values of an RDF packet by property name without its namespace: attributes, texts and list items, in order; nothing where it is no XML."""
    out: dict[str, list[str]] = {}
    if "<!" in packet:  # declarations and entities have no place in a packet
        return out
    # a packet cut out of its root may miss declarations of prefixes
    known, used = set(re.findall(r"xmlns:(\w+)", packet)), set(re.findall(r"[<\s/](\w+):\w", packet))
    bare = "".join(f' xmlns:{p}="urn:{p}"' for p in sorted(used - known - {"xml", "xmlns"}))
    try:
        root = ElementTree.fromstring(f"<root{bare}>{packet}</root>")
    except ElementTree.ParseError:
        return out
    for description in root.iter():
        if _local(description.tag) != "description":
            continue
        for name, value in description.attrib.items():
            out.setdefault(_local(name), []).append(value.strip())
        for prop in description:
            items = [i for i in prop.iter() if _local(i.tag) == "li"] or [prop]
            out.setdefault(_local(prop.tag), []).extend(t for i in items if (t := "".join(i.itertext()).strip()))
    return out


_ELEMENT = re.compile(r"<((?:dc|prism|xmp):(\w+))(?:\s[^>]*)?>(.*?)</\1\s*>", re.S)
_ATTRIBUTE = re.compile(r"""(?:dc|prism|xmp):(\w+)\s*=\s*("[^"]*"|'[^']*')""")


def fragment_fields(text: str) -> dict[str, list[str]]:
    """What a packet that is cut off or broken still says: its properties of the known prefixes, read tag by tag."""
    out: dict[str, list[str]] = {}
    for m in _ELEMENT.finditer(text):
        items = re.findall(r"<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li\s*>", m[3], re.S) or [m[3]]
        out.setdefault(m[2].lower(), []).extend(t for i in items if (t := html.unescape(re.sub(r"<[^>]*>", "", i)).strip()))
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), []).append(html.unescape(m[2][1:-1]).strip())
    return out


def literal_string(text: str, at: int) -> str:
    """The string object of a document file that begins at ``at``: in parentheses with nesting and escapes, or hexadecimal."""
    if text[at] == "<":
        digits = re.sub(r"\s", "", text[at + 1 : text.find(">", at)])
        if not re.fullmatch(r"[0-9A-Fa-f]*", digits):
            return ""
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        depth, k, chars = 0, at, []
        while k < len(text):
            c = text[k]
            if c == "\\":
                octal = re.compile(r"[0-7]{1,3}").match(text, k + 1)
                if octal:
                    chars.append(chr(int(octal[0], 8) & 255))
                    k = octal.end()
                    continue
                k += 1
                if text[k : k + 1] not in ("\n", "\r"):  # a line break after the mark is no part of the string
                    chars.append(_ESCAPES.get(text[k : k + 1], text[k : k + 1]))
            elif c == "(":
                depth += 1
                if depth > 1:
                    chars.append(c)
            elif c == ")":
                depth -= 1
                if not depth:
                    break
                chars.append(c)
            else:
                chars.append(c)
            k += 1
        if depth:
            return ""
        if any(ord(c) > 255 for c in chars):
            return "".join(chars).strip()
        raw = "".join(chars).encode("latin-1")
    return raw[2:].decode("utf-16-be", "ignore").strip() if raw[:2] == b"\xfe\xff" else raw.decode("latin-1").strip()


def _entry(text: str, name: str) -> str | None:
    for m in re.compile(rf"/{name}\s*(?=[(<])(?!<<)").finditer(text):
        value = literal_string(text, m.end())
        if value:
            return value
    return None


def metadata_of(text: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(title, creators, date, doi) of a file's head and tail: the packet says first, then the information dictionary."""
    found: dict[str, list[str]] = {}
    for m in _PACKET.finditer(text or ""):
        for name, values in packet_fields(m[0]).items():
            found.setdefault(name, []).extend(values)
    if not found:
        found = fragment_fields(text or "")
    first = lambda *names: next((v for n in names for v in found.get(n, []) if v), None)
    names = list(dict.fromkeys(v for v in found.get("creator", []) if v))
    date = _DATE.match(first("date", "createdate") or _entry(text or "", "CreationDate") or "")
    doi = first("doi") or next((v for v in found.get("identifier", []) if re.match(r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?10\.", v)), None)
    return first("title") or _entry(text or "", "Title"), "; ".join(names) or _entry(text or "", "Author"), "-".join(x for x in date.groups() if x) if date else None, doi


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "creator", "date", "doi")]))
def embedded_metadata(texts: pd.Series) -> pd.DataFrame:
    """struct(title, creator, date, doi) of each file's head and tail; all creators, the date as far as it is known."""
    return pd.DataFrame([metadata_of(t) for t in texts], columns=["title", "creator", "date", "doi"])


def identify(files: DataFrame, candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, level, kind, value, title) of files (key, file_name, text) by the first stage that succeeds.

    1 an identifier in the text; 2 a DOI in the embedded metadata; 3 the best candidate for the embedded
    title; 4 the best for the file name; 0 none. candidates: key, pos, title, doi. Only files that the cheap
    stages leave open meet the candidates, by key, and similarity is computed for those alone.
    """
    f = files.select("key", ids.found_identifier(F.col("text")).alias("f"), embedded_metadata(F.col("text")).alias("m"), tx.title_from_file_name(F.col("file_name")).alias("name_title"))
    f = f.withColumn("level", F.when(F.col("f.kind").isNotNull(), 1).when(F.col("m.doi").isNotNull(), 2))
    done = f.where("level is not null").select("key", "level", F.when(F.col("level") == 1, F.col("f.kind")).otherwise("doi").alias("kind"), F.coalesce("f.value", "m.doi").alias("value"), F.col("m.title").alias("title"))
    left = f.where("level is null").select("key", "m", F.explode(F.array(F.struct(F.lit(3).alias("level"), F.col("m.title").alias("wanted")), F.struct(F.lit(4).alias("level"), F.col("name_title").alias("wanted")))).alias("w"))
    left = left.select("key", "m", "w.*")
    usable = left.where(tx.usable_title(F.col("wanted")) & (tx.normalize_title(F.col("wanted")) != ""))
    scored = usable.join(candidates.where(F.col("doi").isNotNull()), "key").withColumn("score", jaro_winkler_udf(tx.normalize_title(F.col("wanted")), tx.normalize_title(F.col("title"))))
    best = scored.where(F.col("score") >= threshold).groupBy("key").agg(F.min_by(F.struct("level", "doi", "title"), F.struct("level", -F.col("score"), "pos")).alias("b"))
    found = best.select("key", F.col("b.level").alias("level"), F.lit("doi").alias("kind"), ids.doi_reference(F.col("b.doi")).alias("value"), F.col("b.title").alias("title"))
    none = left.select("key", F.col("m.title").alias("title")).distinct().join(found, "key", "left_anti")
    nothing = F.lit(None).cast("string")
    return done.unionByName(found).unionByName(none.select("key", F.lit(0).alias("level"), nothing.alias("kind"), nothing.alias("value"), "title"))


def identification_counts(found: DataFrame) -> DataFrame:
    """One row from the rows of ``identify``: files, identified ones, those that are not, and the identified ones by level."""
    return found.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("level") > 0).alias("identified"), F.count_if(F.col("level") == 0).alias("unidentified"), *[F.count_if(F.col("level") == k).alias(f"level_{k}") for k in (1, 2, 3, 4)]
    )
