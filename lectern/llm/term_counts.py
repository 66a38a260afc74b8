"""Term counts of whole Arrow batches of text: bytes, hashes and sorting, without a Python loop over terms.

A term is a maximal run of ASCII letters and non-ASCII characters, with only A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import bound_batches, mix, raw_bytes, slices, span_hashes, spans

#: Bytes of text worked through at once (or one text), and counts gathered before they are sent on.
SLICE, GATHER = 1 << 20, 1 << 20
_TERM = np.zeros(256, bool)
_TERM[ord("a") : ord("z") + 1] = _TERM[ord("A") : ord("Z") + 1] = _TERM[128:] = True
#: Bytes dealt anew for a second hash, so that two terms count as one only where 128 bits agree.
_OTHER = np.random.default_rng(13).permutation(256).astype(np.uint8)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places) that bring rows equal in all keys together."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = mix(mixed + k.astype(np.uint64))
    order = np.argsort(mixed)
    m = mixed[order]
    new = np.ones(len(order), bool)
    new[1:] = m[1:] != m[:-1]
    differ = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        differ |= k[1:] != k[:-1]
    if (differ & ~new[1:]).any():  # unlike rows with one mixed key: sort by the keys themselves
        order = np.lexsort(keys)
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of a buffer as an Arrow string array."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[take])))


class _Gathered:
    """Counts by (group, term) of the slices since the last flush."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.terms: list[pa.Array] = []
        self.rows = 0

    def add(self, text: pa.Array, group: np.ndarray) -> None:
        buf, offsets = raw_bytes(text)
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        start, end, doc = spans(buf, offsets, _TERM)
        if not len(start):
            return
        h, h2 = span_hashes(buf, start, end), span_hashes(_OTHER[buf], start, end)
        order, first = _runs(h2, h, doc)
        n = np.diff(np.append(first, len(order)))
        at = order[first]
        h, h2, g = h[at], h2[at], group[doc[at]]
        again, f = _runs(h2, h, g)
        keep = at[again[f]]
        self.parts.append((g[again[f]], h[again[f]], h2[again[f]], np.add.reduceat(n[again], f), np.diff(np.append(f, len(again)))))
        self.terms.append(strings(buf, start[keep], end[keep]))
        self.rows += len(f)

    def flush(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        g, h, h2, n, df = (np.concatenate(p) for p in zip(*self.parts))
        terms = pa.concat_arrays(self.terms)
        order, first = _runs(h2, h, g)
        keep = order[first]
        names = list(self.groups)
        lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(g[keep])) for k in (0, 1))
        out = pa.RecordBatch.from_arrays(
            [lang, source, terms.take(pa.array(keep)).cast(pa.string()), pa.array(np.add.reduceat(n[order], first)), pa.array(np.add.reduceat(df[order], first))], names=["lang", "source", "term", "n", "df"]
        )
        self.__init__()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Gathered()
    for b in batches:
        text = b.column(2)
        for lo, hi in slices(text, SLICE):
            pairs = list(zip(b.column(0)[lo:hi].to_pylist(), b.column(1)[lo:hi].to_pylist()))
            group = np.array([held.groups.setdefault(p, len(held.groups)) for p in pairs], np.int64)
            held.add(text[lo:hi], group)
            if held.rows >= GATHER:
                yield held.flush()
    last = held.flush()
    if last is not None:
        yield last


def grouped_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in parts of the table, several rows a term; null counts as empty."""
    bound_batches(docs.sparkSession)
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(column(lang_col).alias("lang"), column(source_col).alias("source"), column(text_col).alias("text"))
    return rows.mapInArrow(_count, "lang string, source string, term string, n long, df long")
