"""N-gram Jaccard self-join of documents: Bayesian pruning of MinHash candidates, then exact verification.

Documents with equal shingle sets are one class and travel as one row. Classes that share an LSH
band with another class form, with everything reachable that way, a candidate cluster. Inside a
cluster, block by block, MinHash values are compared a few at a time; a pair goes as soon as the
posterior probability that its similarity reaches the threshold falls below the tolerance, and the
rest is verified on the full shingle sets. Blocks return link counts and a spanning forest of the
links, never all pairs, so output stays proportional to the number of documents even where thousands
of different texts are all alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.id_filter import FILTER_BITS, bitmap, flagged
from lectern.operators.graph import connected_components
from lectern.storage import materialize

#: MinHash values of a document, the most of them in one band, and the probability that a pair at the threshold shares no band.
N_HASHES, BAND_VALUES, MISSED = 160, 5, 1e-5
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, N_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)
_C = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs are compared in tiles of this many rows a side; a block holds at most this many documents and shingles.
TILE, BLOCK_DOCS, BLOCK_SHINGLES = 1024, 4096, 2_000_000
SEEDS = (0x51ED270B7A1F3C29, 0x2545F4914F6CDD1D)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, values a band): the longest bands of which a pair at the threshold shares none with probability MISSED at most; 32 of 5 for 0.8.

    Raises ValueError below about 0.07, where bands of one value would miss more.
    """
    for rows in range(BAND_VALUES, 0, -1):
        if (1 - threshold**rows) ** (N_HASHES // rows) <= MISSED:
            return N_HASHES // rows, rows
    raise ValueError(f"a threshold of {threshold} is too low for {N_HASHES} values")


def minhashes(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_HASHES) uint32: least value of each random linear permutation; documents without shingles get the greatest value."""
    out = np.full((len(offsets) - 1, N_HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    if len(full):
        x, at = (s >> np.uint64(32)).astype(np.uint32), offsets[full]
        work = np.empty_like(x)
        for j in range(N_HASHES):
            np.multiply(x, _A[j], out=work)
            np.add(work, _B[j], out=work)
            out[full, j] = np.minimum.reduceat(work, at)
    return out


def least_matches(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    """[(n, m)]: after n compared values, a pair with fewer than m matches goes.

    With a uniform prior on the similarity s, m matches in n leave a Beta(m+1, n-m+1) posterior;
    P(s >= t) is the chance that a Binomial(n+1, t) variable is at most m.
    """
    out = []
    for n in range(step, N_HASHES + 1, step):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out.append((n, m))
                break
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprint(s: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit sum for each document's set."""
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(words.mix(s ^ np.uint64(seed)), out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def class_keys(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, fp1, fp2, n_shingles, bands): fp1, fp2 and n_shingles name the shingle set."""
    n_bands, n_rows = banding(threshold)
    weights = _C[: n_bands * n_rows].reshape(n_bands, n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, to in words.slices(b.column(1)):
                s, offsets = words.shingles(b.column(1).slice(lo, to - lo), width)
                n = len(offsets) - 1
                counts = np.diff(offsets)
                sums = [fingerprint(s, offsets, seed) for seed in SEEDS]
                sig = minhashes(s, offsets)[:, : n_bands * n_rows].astype(np.uint64).reshape(n, n_bands, n_rows)
                bands = words.mix((sig * weights).sum(axis=2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, dtype=np.int32)), _signed(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, to - lo), b.column(2).slice(lo, to - lo), _signed(sums[0]), _signed(sums[1]), pa.array(counts.astype(np.int64)), flat],
                    names=["doc_id", "text_hash", "fp1", "fp2", "n_shingles", "bands"],
                )

    words.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp1 long, fp2 long, n_shingles long, bands array<long>")


def _shingle_rows(docs: DataFrame, members: np.ndarray, width: int) -> DataFrame:
    """(rep, fp1, shingles as bytes) of the documents whose id may be one of ``members``; the other texts go no further."""
    bits = docs.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(2).to_numpy()
            b = b.filter(pa.array((bits.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0))
            for lo, to in words.slices(b.column(1)):
                s, offsets = words.shingles(b.column(1).slice(lo, to - lo), width)
                raw = s.tobytes()
                cut = pa.array([raw[8 * x : 8 * y] for x, y in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, to - lo), _signed(fingerprint(s, offsets, SEEDS[0])), cut], names=["rep", "fp1", "shingles"])

    return docs.select("rep", "text", F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("h")).mapInArrow(run, "rep long, fp1 long, shingles binary")


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|x & y| for all x of a and y of b. Shingles of many documents go through one matrix product, the others pair by pair of the documents that hold them."""
    na, nb = len(a), len(b)
    values = np.concatenate(a + b)
    owner = np.repeat(np.arange(na + nb), [len(x) for x in a + b])
    _, ids, freq = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((na, nb), np.float32)
    many = freq >= 24
    column = np.cumsum(many) - 1
    dense = many[ids]
    n_dense = int(many.sum())
    for lo in range(0, n_dense, 2048):
        c = column[ids]
        here = dense & (c >= lo) & (c < lo + 2048)
        x = np.zeros((na + nb, min(2048, n_dense - lo)), np.float32)
        x[owner[here], c[here] - lo] = 1
        out += x[:na] @ x[na:].T
    rare = ~dense & (freq[ids] > 1)
    order = np.argsort(ids[rare], kind="stable")
    o, i = owner[rare][order], ids[rare][order]
    left, right = o < na, o >= na
    ol, il, orr, ir = o[left], i[left], o[right] - na, i[right]
    first, last = np.searchsorted(ir, il, "left"), np.searchsorted(ir, il, "right")
    n = last - first
    if n.sum():
        x = np.repeat(ol, n)
        y = orr[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out += np.bincount(x * nb + y, minlength=na * nb).reshape(na, nb).astype(np.float32)
    return out


def links_of_tile(sig_a, sig_b, sets_a, sets_b, threshold: float, schedule: list[tuple[int, int]], same: bool) -> np.ndarray:
    """Boolean matrix of the verified links between two lists of documents."""
    first_n, first_m = schedule[0]
    matches = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for j in range(first_n):
        matches += sig_a[:, j, None] == sig_b[None, :, j]
    alive = matches >= first_m
    if same:
        alive = np.triu(alive, 1)
    x, y = np.nonzero(alive)
    got = matches[x, y].astype(np.int32)
    done = first_n
    for n, m in schedule[1:]:
        for lo in range(0, len(x), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            got[part] += (sig_a[x[part], done:n] == sig_b[y[part], done:n]).sum(axis=1, dtype=np.int32)
        stay = got >= m
        x, y, got, done = x[stay], y[stay], got[stay], n
    out = np.zeros(alive.shape, bool)
    if len(x):
        size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
        rows, cols = np.unique(x), np.unique(y)
        if len(x) * 8 >= len(rows) * len(cols):
            both = _intersections([sets_a[k] for k in rows], [sets_b[k] for k in cols])
            inter = both[np.searchsorted(rows, x), np.searchsorted(cols, y)].astype(np.int64)
        else:
            inter = np.array([np.isin(sets_a[p], sets_b[q], assume_unique=True).sum() for p, q in zip(x, y)], np.int64)
        linked = inter >= threshold * (size_a[x] + size_b[y] - inter) - 1e-9
        out[x[linked], y[linked]] = True
    return out | out.T if same else out


def spanning_roots(links: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n nodes, the least node of each one's component, where links joins nodes ``left`` (rows) and ``right`` (columns)."""
    root = np.arange(n)
    for _ in range(n):
        old = root.copy()
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            part = links[lo : lo + 256]
            np.minimum.at(root, rows, np.where(part, root[right][None, :], n).min(axis=1, initial=n))
            np.minimum.at(root, right, np.where(part, root[rows][:, None], n).min(axis=0, initial=n))
        root = np.minimum(root, root[root])
        if (old == root).all():
            break
    return root


def _block_links(threshold: float, schedule: list[tuple[int, int]]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep = table.column("rep").to_numpy()
        first = np.append(True, rep[1:] != rep[:-1])  # a repeated row of the table counts once
        table, rep = table.filter(pa.array(first)), rep[first]
        block = table.column("block").to_numpy()
        n_docs = table.column("n_docs").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        sig = minhashes(np.concatenate(sets), offsets)
        _, bi, bj = (k.as_py() for k in key)
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        links = np.zeros((len(left), len(right)), bool)
        for p in range(0, len(left), TILE):
            for q in range(p if bi == bj else 0, len(right), TILE):
                a, b = left[p : p + TILE], right[q : q + TILE]
                found = links_of_tile(sig[a], sig[b], [sets[k] for k in a], [sets[k] for k in b], threshold, schedule, bi == bj and p == q)
                links[p : p + TILE, q : q + TILE] = found
                if bi == bj and p != q:
                    links[q : q + TILE, p : p + TILE] = found.T
        n_links = np.zeros(len(rep), np.int64)
        n_links[left] += links @ n_docs[right]
        if bi != bj:
            n_links[right] += n_docs[left] @ links
        root = spanning_roots(links, len(rep), left, right)
        some = n_links > 0
        return pa.table({"rep": rep[some], "n_links": n_links[some], "root": rep[root[some]]})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_shingles, kept, n_rows (rows that share the id).

    Two documents link when the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``threshold``. class_id is the least doc_id reachable by links, n_links the number of
    other documents linked directly (equal texts included), kept is doc_id = class_id. Links are
    verified exactly (on 64-bit shingle hashes), so none below the threshold is reported; a link
    at the threshold is missed with probability below 2e-5, less above it: bands are as long as the
    threshold allows (``banding``).

    Defined cases: null or wordless text links with nothing; a text of fewer than ``width`` words
    has one shingle, all its words; rows without an id are left out; rows that repeat an id count as
    one document (the row of least text hash); an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    keys = materialize(class_keys(docs, id_col, text_col, width, threshold), "shingle-classes")
    members = keys.groupBy("doc_id").agg(F.min(F.struct("text_hash", "n_shingles", "fp1", "fp2")).alias("k"), F.count(F.lit(1)).alias("n_rows")).select("doc_id", "n_rows", "k.n_shingles", "k.fp1", "k.fp2")
    classes = (
        keys.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.first("bands").alias("bands"))
        .join(members.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs")), ["fp1", "fp2", "n_shingles"])
    )
    classes = materialize(classes, "classes")
    bands = classes.select("rep", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    stars = bands.join(shared, "key").where("rep <> lo").select(F.col("rep").alias("src"), F.col("lo").alias("dst"))
    clusters = materialize(connected_components(stars).withColumnRenamed("id", "rep").join(classes.select("rep", "n_docs", "n_shingles", "fp1", "fp2"), "rep"), "clusters")
    blocks = clusters.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).where("rep is not null")
    rows = _shingle_rows(texts, bitmap(clusters, "rep"), width).join(clusters.select("rep", "fp1", "component", "n_docs"), ["rep", "fp1"]).join(blocks, "component")
    rows = rows.withColumnRenamed("component", "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = rows.select("cluster", "rep", "n_docs", "shingles", "block", other)
    pairs = pairs.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")
    found = pairs.groupBy("cluster", "bi", "bj").applyInArrow(_block_links(threshold, least_matches(threshold, tolerance)), "rep long, n_links long, root long")
    found = materialize(found, "links")
    component = connected_components(found, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    result = (
        classes.select("fp1", "fp2", "n_shingles", "rep", "n_docs")
        .join(links, "rep", "left")
        .join(component.withColumnRenamed("id", "rep"), "rep", "left")
        .select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("found_class"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("found_links"))
    )
    out = members.join(result, ["fp1", "fp2", "n_shingles"], "left")
    class_id = F.coalesce("found_class", "doc_id")
    return out.select(
        "doc_id",
        class_id.alias("class_id"),
        F.coalesce("found_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
        (class_id == F.col("doc_id")).alias("kept"),
        "n_rows",
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, with all their columns; of rows that repeat an id, the one whose text was compared.

    Rows without an id stay. Texts whose id cannot be one of the dropped or repeated ids, by a filter of
    fixed size, are not moved; only the others meet the list of those ids in a join.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, threshold, width).where("not kept or n_rows > 1").select("doc_id", "kept"), "dropped")
    key, drop, kept = "_near_id", "_near_drop", "_near_kept"
    tagged = flagged(docs.withColumn(key, F.col(id_col).cast("long")), F.col(key), found, "doc_id", drop)
    sure = tagged.where(~F.col(drop)).select(*docs.columns)
    listed = found.select(F.col("doc_id").alias(key), F.col("kept").alias(kept))
    doubtful = tagged.where(drop).join(listed, key, "left").where(F.coalesce(kept, F.lit(True)))
    # of rows that share an id, the one whose text was compared
    order = F.struct(F.xxhash64(F.col(text_col).cast("string")), F.xxhash64(*docs.columns))
    one = doubtful.groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias("_near_row")).select("_near_row.*")
    return sure.unionByName(one)
