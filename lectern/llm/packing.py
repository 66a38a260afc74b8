"""Packing along a space-filling curve: neighbours in content become neighbours in training sequences.

A document's tokens are hashed into a signed vector, projected to a few dimensions, and its place on
the Hilbert curve through that space is its key. Documents are range-sorted by key and laid end to
end; every 2048th token ends a sequence. Ranges know from token totals where they start in the whole,
so they cut independently and only the very last sequence is not full.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.byte_tokens import byte_tokens, default_path
from lectern.storage import materialize

#: Hashed vector length, dimensions of the curve, bits of each dimension.
BUCKETS, DIMS, BITS = 64, 4, 10
#: Tokens that one range should hold, and ranges at most (their token totals pass through the driver).
RANGE_TOKENS, MAX_RANGES = 2_000_000, 20_000


def hilbert(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of integer coordinates (0 .. 2**bits - 1) on the Hilbert curve, by Skilling's transform."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


_rng = np.random.default_rng(97)
_PROJECTION = _rng.standard_normal((BUCKETS, DIMS))


@functools.lru_cache(maxsize=1)
def _hash_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.mix(np.arange(size, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def _hashed(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of every token id below ``size``."""
    return _hash_table(1 << max(16, (size - 1).bit_length()))


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's token ids."""
    n = len(offsets) - 1
    bucket, sign = _hashed(int(ids.max()) + 1 if len(ids) else 1)
    doc = np.repeat(np.arange(n) * BUCKETS, np.diff(offsets))
    v = np.bincount(doc + bucket[ids], sign[ids], n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    flat = (v / np.where(norm > 0, norm, 1)) @ _PROJECTION  # about normal, whatever the length
    place = 1 / (1 + np.exp(-1.7 * flat))
    return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, crc, ids): ids end with ``end_id``, in the vocabulary's integer width; crc orders equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(path)
        end, width = np.array([end_id], tokens.dtype).tobytes(), tokens.dtype().itemsize
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                part = b.slice(lo, to - lo)
                ids = [x + end for x in tokens.encode_batch([t or "" for t in part.column(1).to_pylist()])]
                n = np.array([len(x) // width for x in ids], np.int64)
                keys = curve_keys(np.frombuffer(b"".join(ids), tokens.dtype), np.concatenate(([0], np.cumsum(n))))
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(n), crc, pa.array(ids, pa.binary())], names=["doc_id", "key", "n", "crc", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, n long, crc long, ids binary")


def _cut(length: int, dtype):
    """Pieces of the rows of whole ranges, in order; each row knows where its range starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = None, 0
        for b in batches:
            starts, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            out: list[tuple] = []
            for k, (doc, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist())):
                if starts[k] != current:
                    current = position = int(starts[k])
                ids, at, total = np.frombuffer(raw, dtype).astype("<u4"), 0, int(n[k])
                while at < total:
                    size = min(total - at, length - position % length)
                    out.append((doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), total, position // length, position % length))
                    at, position = at + size, position + size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names=names)

    return run


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; documents follow each other along the Hilbert curve and
    are cut wherever a sequence of ``length`` tokens is full, so all sequences but the last are full.
    Many documents at one place of the curve (copies) are spread over several ranges by a hash.

    Defined cases: null or empty text is the single id ``end_id``; rows are packed one by one, so
    repeated or null ids give a piece each time; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    words.bound_batches(docs.sparkSession)
    path = path or default_path()
    rows = materialize(encoded(docs, path, end_id, id_col, text_col), "encoded")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(1, total // RANGE_TOKENS)))
    target = -(-total // ranges) if total else 1
    shift = max(0, DIMS * BITS - max(6, (8 * ranges).bit_length()))
    placed = rows.withColumn("cell", F.shiftright("key", shift))
    cells = {row["cell"]: row["n"] for row in placed.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    spark = docs.sparkSession
    hot = {c: -(-2 * n // target) for c, n in cells.items() if 2 * n > target}
    spread = F.broadcast(spark.createDataFrame(list(hot.items()), "cell long, parts long"))  # at most twice as many rows as ranges
    placed = placed.join(spread, "cell", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("doc_id", "crc"), F.col("parts")), F.lit(0)))
    bins = placed.groupBy("cell", "sub").agg(F.sum("n").alias("n")).collect()
    starts, at, filled, first = [], 0, 0, 0
    for row in sorted(bins, key=lambda r: (r["cell"], r["sub"])):
        if filled and filled + row["n"] > target:
            first, filled = at, 0
        starts.append((row["cell"], row["sub"], first))
        filled, at = filled + row["n"], at + row["n"]
    table = F.broadcast(spark.createDataFrame(starts, "cell long, sub long, range_start long"))
    ordered = placed.join(table, ["cell", "sub"]).repartition(max(ranges, 1), "range_start")
    ordered = ordered.sortWithinPartitions("range_start", "cell", "sub", "key", "crc", "doc_id").select("range_start", "doc_id", "n", "ids")
    dtype = byte_tokens(path).dtype
    return ordered.mapInArrow(_cut(length, dtype), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
