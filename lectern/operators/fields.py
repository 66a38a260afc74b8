"""Placeholders in word-processor text become citation fields, wherever they are split over runs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"<w:p(?=[ >])(?![^>]*/>).*?</w:p>", re.S)
_RUN = re.compile(r"<w:r(?=[ >])(?![^>]*/>)[^>]*>(?P<inner>(?:(?!<w:r[ >]).)*?)</w:r>", re.S)
_PROPERTIES = re.compile(r"\s*<w:rPr>.*?</w:rPr>", re.S)
_TEXT = re.compile(r"<w:t(?=[ >])[^>]*>(.*?)</w:t>", re.S)


def text_run(properties: str, text: str) -> str:
    return f'<w:r>{properties}<w:t xml:space="preserve">{html.escape(text, quote=False)}</w:t></w:r>' if text else ""


def field_runs(properties: str, code: str, shown: str) -> str:
    """A complex field: begin, instruction, separator, shown text, end."""
    mark = lambda kind: f'<w:r>{properties}<w:fldChar w:fldCharType="{kind}"/></w:r>'
    instruction = f'<w:r>{properties}<w:instrText xml:space="preserve">{html.escape(code, quote=False)}</w:instrText></w:r>'
    return mark("begin") + instruction + mark("separate") + text_run(properties, shown) + mark("end")


def inject(xml: str, fields: dict[str, tuple[str, str]], prefix: str = "cite") -> tuple[str, int]:
    """(xml with fields, placeholders replaced). Text around a placeholder keeps its run's properties; runs that hold more than text, and names without a field, stay as they are."""
    placeholder = re.compile(r"\{\{" + re.escape(prefix) + r":([^{}]*)\}\}")
    replaced = 0

    def paragraph(match: re.Match) -> str:
        nonlocal replaced
        source = match[0]
        runs = []  # start and end in the source, text, properties, whether it holds nothing but text
        for m in _RUN.finditer(source):
            properties = _PROPERTIES.match(m["inner"])
            rest = m["inner"][properties.end() :] if properties else m["inner"]
            text = html.unescape("".join(_TEXT.findall(rest)))
            runs.append((m.start(), m.end(), text, properties[0].strip() if properties else "", not _TEXT.sub("", rest).strip()))
        starts, total = [], 0
        for r in runs:
            starts.append(total)
            total += len(r[2])
        out, at, carried = [], 0, 0  # text before ``carried`` is written already
        for m in placeholder.finditer("".join(r[2] for r in runs)):
            inside = [k for k, r in enumerate(runs) if r[2] and starts[k] < m.end() and starts[k] + len(r[2]) > m.start()]
            if m[1] not in fields or not all(runs[k][4] for k in inside):
                continue
            first, last = inside[0], inside[-1]
            lead_from = max(carried, starts[first])
            if runs[first][0] >= at:
                out.append(source[at : runs[first][0]])
            elif out and carried > starts[first]:
                out.pop()  # the tail that the last placeholder of this run left is cut again here
            out.append(text_run(runs[first][3], runs[first][2][lead_from - starts[first] : m.start() - starts[first]]))
            out.append(field_runs(runs[first][3], *fields[m[1]]))
            out.append(text_run(runs[last][3], runs[last][2][m.end() - starts[last] :]))
            at, carried = runs[last][1], m.end()
            replaced += 1
        return "".join(out) + source[at:]

    return _PARAGRAPH.sub(paragraph, xml), replaced


def inject_fields(documents: DataFrame, mapping: DataFrame, prefix: str = "cite") -> DataFrame:
    """(file, xml, replaced) of documents (file, xml) with the fields of mapping (file, name, code, shown); a document without entries is unchanged."""
    entries = mapping.groupBy("file").agg(F.collect_list(F.struct("name", "code", "shown")).alias("fields"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, xml, fields in zip(b["file"], b["xml"], b["fields"]):
                rows.append((file, *inject(xml, {f["name"]: (f["code"], f["shown"]) for f in (fields if fields is not None else [])}, prefix)))
            yield pd.DataFrame(rows, columns=["file", "xml", "replaced"])

    return documents.select("file", "xml").join(entries, "file", "left").mapInPandas(run, "file string, xml string, replaced int")
