"""Near-duplicate vectors: an exact metric range join.

On unit vectors, cosine >= c is the ball of radius r = sqrt(2 - 2c). Pivots split the vectors of a
label into cells of their nearest pivot; a vector is copied into another cell only where a partner
could live there: by the triangle inequality, a partner y of x in the cell of p has
d(x, p) <= d(x, home) + 2r, in Euclidean space even d(x, p)^2 - d(x, home)^2 <= 2 r d(p, home).
Cells are then joined independently, large ones block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.ngram_join import spanning_roots
from lectern.llm.vectors import matrix, units, usable
from lectern.operators.graph import connected_components
from lectern.storage import materialize

#: Vectors a cell should hold, at most and (on small tables, 1/24 of the rows) at least; pivots in all, their bytes and labels that get any, at most (the pivots are sent to
#: every task); a label without pivots is one cell. Blocks bound what one task holds, however large a cell is.
CELL, LEAST_CELL, MAX_PIVOTS, PIVOT_BYTES, MAX_LABELS, BLOCK = 2048, 64, 8192, 1 << 25, 1024, 4096


def thinned(x: np.ndarray, distance: float) -> np.ndarray:
    """Rows of unit vectors, in order, of which none is within ``distance`` of an earlier one taken; by products of blocks."""
    limit, kept = 1 - distance**2 / 2, np.zeros((0, x.shape[1]))
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        part = part[(part @ kept.T < limit).all(axis=1)] if len(kept) else part
        near = part @ part.T >= limit
        take: list[int] = []
        for k in range(len(part)):
            if not near[k, take].any():
                take.append(k)
        kept = np.concatenate((kept, part[take]))
    return kept


def _pivots(vectors: DataFrame, radius: float) -> dict[tuple[int, int], np.ndarray]:
    """Pivots by (label, components): a hash sample in proportion to each large label, thinned so that no two are within 2 radii, as near copies would all be."""
    sizes = vectors.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    cell = min(CELL, max(LEAST_CELL, (sizes.agg(F.sum("n")).first()[0] or 0) // 24))
    large = sizes.where(F.col("n") >= 2 * cell).orderBy(F.desc("n"), "label", "size").limit(MAX_LABELS).collect()
    total = sum(row["n"] for row in large)
    if not large:
        return {}
    most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * max(row["size"] for row in large))))
    share = min(1 / cell, most / total)
    wanted = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = F.broadcast(vectors.sparkSession.createDataFrame([(r["label"], r["size"]) for r in large], "label long, size int"))
    rows = wanted.join(keys, ["label", "size"]).orderBy("rep").limit(2 * most).select("label", "size", "embedding").collect()
    found: dict[tuple[int, int], list[list[float]]] = {}
    for row in rows:
        found.setdefault((row["label"], row["size"]), []).append(row["embedding"])
    return {key: thinned(units(np.array(x, np.float64)), 2 * radius) for key, x in found.items()}


def _assign(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    """Each vector in its home cell and, not at home, in each cell that may hold a partner of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            take, cell, home = [], [], []
            for key in sorted({*zip(label.tolist(), size.tolist())}):
                rows = np.flatnonzero((label == key[0]) & (size == key[1]))
                p = pivots.get(key)
                if p is None or len(p) < 2:
                    take.append(rows), cell.append(np.zeros(len(rows), np.int64)), home.append(np.ones(len(rows), bool))
                    continue
                between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
                for lo in range(0, len(rows), 1024):
                    part = rows[lo : lo + 1024]
                    squared = np.maximum(0, 2 - 2 * (units(matrix(b.column(4).take(pa.array(part)))) @ p.T))
                    own = squared.argmin(axis=1)
                    inside = squared - squared[np.arange(len(part)), own][:, None] <= 2 * radius * between[own] + 1e-9
                    inside[np.arange(len(part)), own] = True
                    at, c = np.nonzero(inside)
                    take.append(part[at]), cell.append(c), home.append(own[at] == c)
            if take:
                picked = b.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(cell)), pa.array(np.concatenate(home))], names=["label", "size", "rep", "copies", "embedding", "cell", "home"])

    return run


def _cell_links(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        bi, bj = key[-2].as_py(), key[-1].as_py()
        rep, block, copies, home = (table.column(c).to_numpy() for c in ("rep", "block", "copies", "home"))
        x = units(matrix(table.column("embedding")))
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        links = np.zeros((len(left), len(right)), bool)
        for lo in range(0, len(left), 1024):
            links[lo : lo + 1024] = x[left[lo : lo + 1024]] @ x[right].T >= threshold
        links &= home[left][:, None] | home[right][None, :]
        if bi == bj:
            np.fill_diagonal(links, False)
        n_links = np.zeros(len(rep), np.int64)
        linked = np.zeros(len(rep), bool)
        n_links[left] += links @ copies[right]
        linked[left] |= links.any(axis=1)
        if bi != bj:
            n_links[right] += copies[left] @ links
            linked[right] |= links.any(axis=0)
        root = spanning_roots(links, len(rep), left, right)
        n_links[~home] = 0  # a visitor's links are counted in its own cell
        return pa.table({"rep": rep[linked], "n_links": n_links[linked], "root": rep[root[linked]]})

    return run


def embedding_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and the cosine, in double precision, is
    at least ``threshold`` (which must exceed -1). n_links counts the other vectors linked directly,
    component_id is the least vec_id reachable by links, kept is vec_id = component_id. Exact: no
    link is missed and none below the threshold is found.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and
    vectors without a label, link with nothing; vectors of different lengths never link; rows
    without an id are left out; rows that repeat an id count as one (the least by label and vector);
    equal vectors link with each other; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    # two hashes of 64 bits stand for a vector wherever equal ones are brought together
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding"))
    good = rows.where(usable("embedding") & F.col("label").isNotNull())
    counts = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = counts.join(good.select(F.col("vec_id").alias("rep"), "embedding"), "rep")
    classes = materialize(classes.select("label", F.size("embedding").alias("size"), "rep", "copies", "embedding", "h1", "h2"), "vector-classes")
    hashes, classes = classes.select("label", "h1", "h2", "rep", "copies"), classes.drop("h1", "h2")
    cells = classes.mapInArrow(
        _assign(_pivots(classes, radius), radius), "label long, size int, rep long, copies long, embedding array<double>, cell long, home boolean"
    )
    cells = materialize(cells, "cells")
    blocks = cells.groupBy("label", "size", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = cells.join(blocks, ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "blocks")
    found = pairs.groupBy("label", "size", "cell", "bi", "bj").applyInArrow(_cell_links(threshold), "rep long, n_links long, root long")
    found = materialize(found, "links")
    component = connected_components(found, "rep", "root").withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    result = hashes.join(links, "rep", "left").join(component, "rep", "left").select(
        "label", "h1", "h2", F.coalesce("component", "rep").alias("found"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    usable_rows = rows.select("vec_id", F.when(usable("embedding"), F.col("label")).alias("label"), "h1", "h2")
    joined = usable_rows.join(result, ["label", "h1", "h2"], "left")
    component_id = F.coalesce("found", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (component_id == F.col("vec_id")).alias("kept"))
