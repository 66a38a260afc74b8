"""Word boundaries and hashes of whole Arrow batches of text, without a Python loop over words.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased
text. Texts are handled in slices of about half a megabyte, so memory follows the slice (or the longest
single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 19
#: Whole texts that one Arrow batch carries between Spark and Python, at most, and about their bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("0") : ord("9") + 1] = _WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES (or one row) for this session; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive slices of at most ``limit`` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 buffer, int64 offsets) of a string array; null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; no word crosses a document's end."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    is_word = word[buf]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: differences of one running polynomial, shifted back to position 0."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf)), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, len(buf) + 1)[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(text: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct 64-bit hashes of each document's runs of ``width`` words.

    A document of 1 to width-1 words has one shingle, all its words; one without words has none.
    """
    buf, offsets = raw_bytes(pc.utf8_lower(pc.fill_null(text, "")))
    start, end, doc = spans(buf, offsets)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = span_hashes(buf, start, end)
    counts = np.bincount(doc, minlength=n)
    out = np.zeros(len(h), np.uint64)
    valid = np.zeros(len(h), bool)
    if len(h) >= width:
        m = len(h) - width + 1
        valid[:m] = doc[:m] == doc[width - 1 :]
        for k in range(width):
            out[:m] += h[k : k + m] * np.uint64(pow(_INVERSE, 3 * k + 1, 1 << 64))
    first = np.cumsum(counts) - counts
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        at = first[d]
        valid[at] = True
        out[at] = sum(int(x) * pow(_INVERSE, 3 * k + 1, 1 << 64) for k, x in enumerate(h[at : at + counts[d]])) + int(counts[d]) & (1 << 64) - 1
    s, doc = mix(out[valid]), doc[valid]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
