"""Record-level operators: lookups in key order, nested children, notes, batch answers, cache age, created references, documents with placeholders."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx


def clean_keys(keys: Column) -> Column:
    """Keys trimmed, without empty ones and repeats, in their first order."""
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: k != ""))


def lookup(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items for (ord, key) in the order of ord, each key once; keys that no item has are left out."""
    wanted = keys.select("ord", F.trim("key").alias("key")).where("key <> ''").groupBy("key").agg(F.min("ord").alias("ord"))
    return items.join(wanted, "key").orderBy("ord")


def with_children(items: DataFrame, children: DataFrame, order: str, name: str = "children") -> DataFrame:
    """Items with the array of their children's other columns, in ``order``; an item without any has an empty array."""
    rest = [c for c in children.columns if c not in ("parent", order)]
    nested = children.groupBy(F.col("parent").alias("key")).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    return items.join(nested, "key", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def annotation_page(position: Column) -> Column:
    """Whole page index of a JSON position, else null."""
    raw = F.get_json_object(position, "$.pageIndex")
    return F.when(raw.rlike("^-?[0-9]{1,9}$"), raw.cast("int"))


def annotation_notes(annotations: DataFrame) -> DataFrame:
    """(parent, n, note) of (parent, pos, type, page, label, text, comment, link): one note of all annotations, by page, those without one last."""
    label = F.when(F.coalesce("label", F.lit("")) == "", "no page").otherwise(F.concat(F.lit("page "), "label"))
    href = F.replace("link", F.lit('"'), F.lit("&quot;"))
    piece = lambda head, c, tail="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), tx.escape_html(F.col(c)), F.lit(tail)))
    line = F.concat_ws(" ", F.concat(F.lit('<a href="'), href, F.lit('">'), tx.escape_html(F.concat(label, F.lit(" - "), F.coalesce("type", F.lit("annotation")))), F.lit("</a>")), piece('"', "text", '"'), piece("Comment: ", "comment"))
    rows = annotations.select("parent", F.struct(F.col("page").isNull().alias("open"), F.coalesce("page", F.lit(0)).alias("page"), "pos", F.concat(F.lit("<p>"), line, F.lit("</p>")).alias("x")).alias("r"))
    t = rows.groupBy("parent").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: r["x"]), "")
    return t.select("parent", F.size("rs").alias("n"), F.concat(F.lit("<h1>Annotations ("), F.size("rs").cast("string"), F.lit(")</h1>"), body).alias("note"))


BATCH = "successful map<string,struct<key:string>>, success map<string,string>, failed map<string,struct<code:int,message:string>>, key string"


def batch_results(answers: DataFrame) -> DataFrame:
    """(batch, idx, key, error) of (batch, body): one row per created or failed entry of a write answer."""
    p = answers.select("batch", F.from_json("body", BATCH).alias("p"))
    made = p.select("batch", F.explode("p.successful").alias("idx", "v")).select("batch", F.col("idx").cast("int").alias("idx"), F.col("v.key").alias("key"), F.lit(None).cast("string").alias("error"))
    lost = p.select("batch", F.explode("p.failed").alias("idx", "v")).select("batch", F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("HTTP "), F.col("v.code").cast("string")).alias("error"))
    return made.unionByName(lost)


def fresh(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """requests plus cached: whether the cache (key, cached_at) holds an answer no older than the limit; the newest counts."""
    newest = cache.groupBy("key").agg(F.max("cached_at").alias("cached_at"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp"))
    return requests.join(newest, "key", "left").withColumn("cached", F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(False)))


def resolve_created(operations: DataFrame) -> DataFrame:
    """Operations (plan, seq, kind, key, value) whose value '@created:n' becomes the key that the plan's n-th create made, from 0; unknown references give null."""
    made = operations.where("kind = 'create'").withColumn("n", F.row_number().over(Window.partitionBy("plan").orderBy("seq")) - 1).select("plan", F.concat(F.lit("@created:"), F.col("n").cast("string")).alias("ref"), F.col("key").alias("made"))
    refers = F.col("value").startswith("@created:")
    joined = operations.join(made.withColumnRenamed("ref", "value"), ["plan", "value"], "left")
    return joined.withColumn("value", F.when(refers, F.col("made")).otherwise(F.col("value"))).drop("made")


def deletions(keys: DataFrame, in_trash: Column, permanent: bool) -> DataFrame:
    """(key, step, kind): trash first what is not in the trash, then delete where asked for."""
    steps = F.array_compact(F.array(F.when(~F.coalesce(in_trash, F.lit(False)), "trash"), F.lit("delete") if permanent else F.lit(None)))
    return keys.select("key", F.posexplode(steps).alias("step", "kind"))


def packed_parts(files: DataFrame, names: str = ".*\\.xml", most: int = 64 << 20) -> DataFrame:
    """(file, name, content, error) of the entries of ZIP files (path, content), as ``binaryFile`` reads them, whose name matches.

    Only those are unpacked. An entry of more than ``most`` bytes has no content but an error, and so has a file
    that is no readable archive.
    """
    wanted = re.compile(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.infolist():
                            if wanted.fullmatch(entry.filename):
                                fits = entry.file_size <= most
                                rows.append((path, entry.filename, z.read(entry) if fits else None, None if fits else "too large"))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError, zlib.error) as e:
                    rows.append((path, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["file", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "file string, name string, content binary, error string")


def paragraphs(parts: DataFrame) -> DataFrame:
    """(file, paragraph, text) of (file, xml): text of each w:p, its runs joined."""
    found = F.regexp_extract_all("xml", F.lit("(?s)<w:p(?=[ >/])(?:[^>]*/>|.*?</w:p>)"), F.lit(0))
    rows = parts.select("file", F.posexplode(found).alias("paragraph", "p"))
    text = F.array_join(F.regexp_extract_all("p", F.lit("(?s)<w:t(?=[ >/])[^>]*>(.*?)</w:t>"), F.lit(1)), "")
    return rows.select("file", "paragraph", tx.decode_entities(text).alias("text"))


def placeholders(rows: DataFrame, prefix: str = "cite") -> DataFrame:
    """(file, paragraph, nth, name) of every {{prefix:name}} in (file, paragraph, text)."""
    return rows.select("file", "paragraph", F.posexplode(F.regexp_extract_all("text", F.lit("\\{\\{" + prefix + ":([^{}]*)\\}\\}"), F.lit(1))).alias("nth", "name"))


def placeholder_report(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, name, hits, state): mapped exactly once is ok; repeated, unmapped and, for mapping entries nobody uses, unused. mapping: file, name."""
    hits = found.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"))
    known = mapping.select("file", "name").distinct().withColumn("known", F.lit(True))
    both = hits.join(known, ["file", "name"], "full_outer")
    state = F.when(F.col("known").isNull(), "unmapped").when(F.col("n").isNull(), "unused").when(F.col("n") > 1, "repeated").otherwise("ok")
    return both.select("file", "name", F.coalesce("n", F.lit(0)).alias("hits"), state.alias("state"))


def first_attachment(attachments: DataFrame) -> DataFrame:
    """(parent, key, is_pdf): of each item's attachments (key, parent, content_type, n_annotations) the first PDF, one with annotations before others; without a PDF the first of all."""
    pdf = F.col("content_type") == "application/pdf"
    order = F.struct(~pdf, ~(F.coalesce("n_annotations", F.lit(0)) > 0), F.col("key"))
    best = attachments.groupBy("parent").agg(F.min_by(F.struct("key", pdf.alias("is_pdf")), order).alias("a"))
    return best.select("parent", "a.key", "a.is_pdf")


def union_by_key(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """Rows of both ways of access, one a key; those of the first win. A combinable aggregate."""
    rest = [c for c in first.columns if c != key]
    both = first.select("*", F.lit(0).alias("_way")).unionByName(second.select(*first.columns, F.lit(1).alias("_way")))
    best = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_way", *rest)).alias("_r"))
    return best.select(key, "_r.*").select(*first.columns)


def require_all(items: DataFrame, keys: DataFrame) -> DataFrame:
    """``lookup`` that raises ValueError, naming up to ten of them, where any key is absent."""
    absent = [r["key"] for r in keys.select(F.trim("key").alias("key")).where("key <> ''").distinct().join(items, "key", "left_anti").orderBy("key").limit(10).collect()]
    if absent:
        raise ValueError(f"no items for: {', '.join(map(str, absent))}")
    return lookup(items, keys)
