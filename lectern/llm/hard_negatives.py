"""Hard negatives by integer inner products: an orthogonal rotation onto principal axes, partial products, bounds, exact products of what is left.

A rotation keeps inner products, and principal axes put most of a vector into its leading components. So the
product of two vectors is the product of their leading components, give or take the product of the norms of
their remainders (Cauchy-Schwarz) and some slack for rounding. A pair whose bounds cannot reach what its anchor still
needs is dropped; the others get further components and at last their integer product. Rows and anchors are dealt out in
blocks, and a task holds one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Fixed values of the integer form: components times SCALE, rounded down.
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the least share of the positive's score, in hundredths, that a negative has.
POSITIVES, NEGATIVES, MARGIN = 5, 5, 80
#: Rows and anchors of one block, and pairs that are bounded at once.
ROWS, ANCHORS, PAIRS = 8192, 4096, 1 << 20
#: Remaining shares of the squares at which the leading components end, stage by stage.
STAGES = (0.5, 0.2, 0.05)
#: Rotations that are sent to every task, at most, by their bytes; vectors of further lengths are bounded on their own axes.
ROTATION_BYTES = 1 << 26
#: Products up to this size are exact in double precision.
_EXACT = float(1 << 52)
#: Scores at the ends of long stand for all beyond.
_LOWEST = -float(1 << 63)


def _lists(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in double precision, which is exact unless it overflows: then infinite."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _exact(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(SCALE * x))


def products(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    """Integer products of paired rows as long: in double precision while that is exact, else in whole numbers of any size, held to the range of long."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", x, y)
        unsafe = ~(np.einsum("ij,ij->i", np.abs(x), np.abs(y)) < _EXACT)
    scores = np.where(unsafe, 0, out).astype(np.int64)
    for k in np.flatnonzero(unsafe):
        total = sum(_exact(a) * _exact(b) for a, b in zip(raw_x[k].tolist(), raw_y[k].tolist()))
        scores[k] = max(-(1 << 63), min((1 << 63) - 1, total))
    return scores


def rotations(rows: DataFrame) -> dict[int, tuple[np.ndarray, list[int]]]:
    """Principal axes and stage ends by vector length. Squares are summed inside the tasks, one matrix a task and length reaches the next step."""
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(64).collect()
    wanted, used = [], 0
    for row in sizes:
        used += 16 * row["size"] ** 2
        if row["size"] and used <= ROTATION_BYTES:
            wanted.append(row["size"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            size = b.column(0).to_numpy()
            for d in sorted({*size.tolist()} & {*wanted}):
                x = _lists(b.column(1).take(pa.array(np.flatnonzero(size == d))), d)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["size", "i", "row"])

    found: dict[int, np.ndarray] = {d: np.zeros((d, d)) for d in wanted}
    if wanted:
        parts = rows.select("size", "embedding").mapInArrow(squares, "size int, i int, row array<double>")
        cells = parts.select("size", "i", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
        for row in cells.groupBy("size", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).collect():
            found[row["size"]][row["i"]] = [c["v"] for c in row["r"]]
    out = {}
    for d, total in found.items():
        if not np.isfinite(total).all():
            continue
        values, axes = np.linalg.eigh((total + total.T) / 2)
        left = 1 - np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        ends = sorted({min(d, int(np.searchsorted(-left, -s)) + 1) for s in STAGES})
        out[d] = (np.ascontiguousarray(axes[:, ::-1]), ends)
    return out


class _Side:
    """A block's vectors: integer form, rotated form, and the norms of what each stage leaves."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray | None, ends: list[int]):
        self.raw, self.whole = raw, integers(raw)
        with np.errstate(over="ignore", invalid="ignore"):
            self.turned = self.whole @ axes if axes is not None else self.whole
            self.left = [np.sqrt((self.turned[:, e:] ** 2).sum(axis=1)) for e in ends]
            self.norm = np.sqrt((self.whole**2).sum(axis=1))


def candidates(rows: _Side, anchors: _Side, at: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of the pairs of rows ``at`` and all anchors whose product may lie between each anchor's least and most."""
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-9 * np.outer(rows.norm[at], anchors.norm) + 1e-6
        sums = rows.turned[at, : ends[0]] @ anchors.turned[:, : ends[0]].T
        gap = np.outer(rows.left[0][at], anchors.left[0]) + slack
        # bounds that are not numbers drop nothing
        r, a = np.nonzero(allowed & ~(sums + gap < least) & ~(sums - gap > most))
        part, slack = sums[r, a], slack[r, a]
        for k in range(1, len(ends)):
            part = part + np.einsum("ij,ij->i", rows.turned[at[r], ends[k - 1] : ends[k]], anchors.turned[a, ends[k - 1] : ends[k]])
            gap = rows.left[k][at[r]] * anchors.left[k][a] + slack
            keep = ~(part + gap < least[a]) & ~(part - gap > most[a])
            r, a, part, slack = r[keep], a[keep], part[keep], slack[keep]
    return at[r], a


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, group))
    g = group[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - first < k]


def _chunks(n: int, n_anchors: int) -> Iterator[tuple[int, int]]:
    step = max(16, PAIRS // max(1, n_anchors))
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def _positives(turns: dict[int, tuple[np.ndarray, list[int]]]):
    """Best rows of the same label for each anchor of a block, label by label."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            size = key[0].as_py()
            axes, ends = turns.get(size, (None, [size]))
            anchor_id, anchor_label = anchors["a_id"].to_numpy(), anchors["a_label"].to_numpy()
            row_id, row_label = rows["id"].to_numpy(), rows["label"].to_numpy()
            x, q = _lists(rows["embedding"], size), _lists(anchors["a_embedding"], size)
            for label in np.intersect1d(anchor_label, row_label):
                of_label, mine = np.flatnonzero(anchor_label == label), np.flatnonzero(row_label == label)
                r, a, ids, owner = _Side(x[mine], axes, ends), _Side(q[of_label], axes, ends), row_id[mine], anchor_id[of_label]
                least, most = np.full(len(owner), -np.inf), np.full(len(owner), np.inf)
                held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3  # anchor, row, score
                for lo, hi in _chunks(len(ids), len(owner)):
                    i, j = candidates(r, a, np.arange(lo, hi), least, most, ids[lo:hi, None] != owner[None, :], ends)
                    s = products(r.whole[i], a.whole[j], r.raw[i], a.raw[j])
                    j, i, s = (np.concatenate(p) for p in zip(held, (j, i, s)))
                    keep = best(j, s, ids[i], POSITIVES)
                    held = j[keep], i[keep], s[keep]
                    full = np.bincount(held[0], minlength=len(owner)) >= POSITIVES
                    worst = np.full(len(owner), np.inf)
                    np.minimum.at(worst, held[0], held[2].astype(np.float64))
                    least = np.where(full & (worst > _LOWEST), worst, -np.inf)
                for column, v in zip(out, (owner[held[0]], ids[held[1]], held[2])):
                    column.append(v)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(("anchor_id", "positive_id", "score"), out)})

    return run


def _negatives(turns: dict[int, tuple[np.ndarray, list[int]]]):
    """For each anchor of a block and each score of its positives, the best rows of other labels that are near enough below it."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        if rows.num_rows and anchors.num_rows:
            size = key[0].as_py()
            axes, ends = turns.get(size, (None, [size]))
            r, a = _Side(_lists(rows["embedding"], size), axes, ends), _Side(_lists(anchors["a_embedding"], size), axes, ends)
            ids, owner = rows["id"].to_numpy(), anchors["a_id"].to_numpy()
            row_label, anchor_label = rows["label"].to_numpy(), anchors["a_label"].to_numpy()
            lists = [sorted({*p}, reverse=True) for p in anchors["a_scores"].to_pylist()]
            slots = max(map(len, lists))
            high = np.array([p + [-1] * (slots - len(p)) for p in lists], np.int64)  # scores below 0 have no negatives: -1 is no score
            floor = np.where(high >= 0, high - (high // 100 * (100 - MARGIN) + high % 100 * (100 - MARGIN) // 100), np.iinfo(np.int64).max)  # ceil of MARGIN hundredths
            need, most = floor.astype(np.float64), np.where(high[:, 0] == np.iinfo(np.int64).max, np.inf, high[:, 0].astype(np.float64))
            held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3  # anchor * slots + slot, row, score
            for lo, hi in _chunks(len(ids), len(owner)):
                # doubles round long scores by less than one part in 2^52: one more unit of slack keeps them in
                least = need.min(axis=1)
                i, j = candidates(r, a, np.arange(lo, hi), least - np.abs(least) * 1e-15, most + np.abs(most) * 1e-15, row_label[lo:hi, None] != anchor_label[None, :], ends)
                s = products(r.whole[i], a.whole[j], r.raw[i], a.raw[j])
                parts = [held]
                for k in range(slots):
                    fits = (s <= high[j, k]) & (s >= floor[j, k]) & (high[j, k] >= 0)
                    parts.append((j[fits] * slots + k, i[fits], s[fits]))
                slot, i, s = (np.concatenate(p) for p in zip(*parts))
                keep = best(slot, s, ids[i], NEGATIVES)
                held = slot[keep], i[keep], s[keep]
                full = (np.bincount(held[0], minlength=need.size) >= NEGATIVES).reshape(need.shape)
                worst = np.full(need.size, np.inf)
                np.minimum.at(worst, held[0], held[2].astype(np.float64))
                need = np.where(full, worst.reshape(need.shape), floor.astype(np.float64))
            out = [owner[held[0] // slots], high.reshape(-1)[held[0]], ids[held[1]], held[2]]
        return pa.table(dict(zip(("anchor_id", "positive_score", "negative_id", "negative_score"), out)))

    return run


def _meet(rows: DataFrame, anchors: DataFrame, key: list[str], run, schema: str) -> DataFrame:
    """Each block of rows with each block of anchors of the same key; both sides know the other's number of blocks."""
    n_rows = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("row_blocks"))
    n_anchors = anchors.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("anchor_blocks"))
    blocks = F.broadcast(materialize(n_rows.join(n_anchors, key), "blocks"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, key).select(*rows.columns, block("row_blocks").alias("rb"), each("anchor_blocks").alias("ab"))
    right = anchors.join(blocks, key).select(*anchors.columns, block("anchor_blocks").alias("ab"), each("row_blocks").alias("rb"))
    right = right.select(*[F.col(c).alias(f"a_{c}") for c in right.columns])  # the sides come from one table: names tell them apart
    keys = [*key, "rb", "ab"]
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"a_{k}" for k in keys])).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are the POSITIVES other rows of its
    label with the highest integer product, and for each positive the negatives are the NEGATIVES rows of other labels with the highest products
    among those from MARGIN hundredths of the positive's up to it. Ties go to smaller ids. Exact.

    Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; empty
    vectors have product 0 with each other; vectors of different lengths never meet; rows that repeat an id count as one
    (the least by label and vector); positives with a negative score have no negatives; products beyond long count as
    its ends; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    e = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), e.alias("embedding"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("id", "r.*")
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return mine(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite), every)


def mine(rows: DataFrame, every: int) -> DataFrame:
    """``hard_negatives`` of clean rows (id, label, embedding) with unique ids."""
    rows = materialize(rows.withColumn("size", F.size("embedding")), "vectors")
    turns = rotations(rows)
    anchors = rows.where(F.col("id") % every == 0)
    # labels share cells, so that many small labels make no more groups than their rows need; a cell of a large label has several blocks
    cells = max(1, rows.count() // ROWS)
    cell = F.pmod(F.xxhash64("label"), F.lit(cells)).cast("int")
    near = _meet(rows.withColumn("cell", cell), anchors.withColumn("cell", cell), ["size", "cell"], _positives(turns), "anchor_id long, positive_id long, score long")
    top = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = materialize(near.withColumn("k", F.row_number().over(top)).where(F.col("k") <= POSITIVES).select("anchor_id", "positive_id", F.col("score").alias("positive_score")), "positives")
    scores = positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list("positive_score").alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor_id", "id"), "id")
    far = _meet(rows, asked, ["size"], _negatives(turns), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return positives.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
