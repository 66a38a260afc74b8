"""Citation exports: entries from templates, checks of bibliography text, audits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def bibtex(key: Column, title: Column, author: Column, year: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), text(title), F.lit("},\n  author = {"), text(author), F.lit("},\n  year = {"), text(year), F.lit("}\n}"))


def ris(title: Column, year: Column) -> Column:
    return F.concat(F.lit("TY  - JOUR\nTI  - "), F.coalesce(title, F.lit("")), F.lit("\nPY  - "), F.coalesce(year, F.lit("")), F.lit("\nER  -"))


def csl_json(key: Column, item_type: Column, title: Column, doi: Column) -> Column:
    kind = F.when(item_type == "book", "book").otherwise("article-journal")
    return F.to_json(F.struct(key.alias("id"), kind.alias("type"), title.alias("title"), doi.alias("DOI")), {"ignoreNullFields": "false"})


#: Blocks of a bibliography that are no entries.
NO_ENTRIES = frozenset(("comment", "string", "preamble"))
_TOKEN = re.compile(r"\\.|^@|[{}()\",=#\n]|[^\s{}()\",=#\\]+", re.M)


def scan(content: str) -> list[tuple[str, str | None, list[str], bool]]:
    """(type, key, field names, closed) of each entry of a bibliography, in one pass over its tokens.

    An entry is @type{key, name = value, ...} or the same in parentheses. Values are braced, quoted or bare and joined by #;
    field names are the words before = outside of all values. @ at the beginning of a line ends what was left open.
    Everything outside of entries is commentary; @comment, @string and @preamble are skipped.
    """
    out: list[tuple[str, str | None, list[str], bool]] = []
    kind, key, names, depth, quoted, word, state, closer = "", None, [], 0, False, "", "outside", "}"

    def end(closed: bool) -> None:
        nonlocal state
        if state != "outside" and kind and kind not in NO_ENTRIES:
            out.append((kind, key, names, closed))
        state = "outside"

    for found in _TOKEN.finditer(content):
        t = found.group()
        if t == "@" and (found.start() == 0 or content[found.start() - 1] == "\n"):
            end(False)
            kind, key, names, depth, quoted, word, state = "", None, [], 0, False, "", "type"
        elif state == "type":
            if t in "{(":
                state, depth, closer = "head", 1, "}" if t == "{" else ")"
            elif t[0].isalpha() and not kind:
                kind = t.lower()
            elif t != "\n":
                end(False)
        elif state == "outside":
            continue
        elif t == '"' and depth == 1 and state == "value":
            quoted = not quoted
        elif quoted:
            depth += (t == "{") - (t == "}")
        elif t == closer and depth == 1:
            key = word if state == "head" and word else key
            end(True)
        elif t in "{}":
            depth += 1 if t == "{" else -1
        elif depth == 1 and t == ",":
            key = word if state == "head" and word else key
            state, word = "name", ""
        elif depth == 1 and t == "=" and state == "name":
            names.append(word.lower())
            state, word = "value", ""
        elif depth == 1 and t != "\n":
            word = t if not word else word + " " + t
    end(False)
    return out


_ENTRIES = ArrayType(StructType([StructField("type", StringType()), StructField("key", StringType()), StructField("names", ArrayType(StringType())), StructField("closed", BooleanType())]))


@F.pandas_udf(_ENTRIES)
def entries(contents: pd.Series) -> pd.Series:
    """The entries of each bibliography text; none of a null one."""
    return contents.map(lambda c: [dict(zip(("type", "key", "names", "closed"), e)) for e in scan(c or "")])


def count_entries(content: Column) -> Column:
    return F.size(entries(content))


def audit(files: DataFrame, require_year: bool = True) -> DataFrame:
    """(file, entry, key, problems) for each entry of (file, content); an entry without problems has none listed.

    Checked are the head @type{key,, that the entry is closed, and its fields title, author and, where asked for, year. A file may come
    in several rows, each with whole entries: then no text has to hold a whole file.
    """
    rows = files.select("file", F.posexplode(entries(F.col("content"))).alias("entry", "e"))
    needed = F.array(*map(F.lit, ["title", "author", *(["year"] if require_year else [])]))
    lacks = F.transform(F.array_except(needed, F.col("e.names")), lambda f: F.concat(F.lit("lacks "), f))
    open_ = F.when(F.col("e.closed"), F.array().cast("array<string>")).otherwise(F.array(F.lit("unbalanced")))
    return rows.select("file", "entry", F.col("e.key").alias("key"), F.when(F.col("e.key").isNull(), F.array(F.lit("no head"))).otherwise(F.concat(open_, lacks)).alias("problems"))


def file_report(audited: DataFrame) -> DataFrame:
    """(file, n_entries, n_keys, n_problems, n_undated, ok)."""
    t = audited.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count("key").alias("n_keys"), F.sum(F.size("problems")).alias("n_problems"), F.count_if(F.array_contains("problems", "lacks year")).alias("n_undated")
    )
    return t.withColumn("ok", (F.col("n_problems") == 0) & (F.col("n_keys") > 0))
