"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection; a
small network learns which parts a vector's neighbours lie in. Every vector is indexed in its most
probable part, a query is sent to its most probable parts, as many as a held-out part of the sample
needs, and the candidates there are reranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.vectors import matrix, units, usable
from lectern.storage import materialize

#: Rows the index is fitted on, about; rows of it held out to choose the number of probes; neighbours in the graph;
#: vectors a part should hold, at most and (on small tables, 1/16 of the rows) at least; parts at most (a power of 2);
#: recall that the held-out rows must reach.
FIT_ROWS, HELD_OUT, DEGREE, PART, LEAST_PART, MAX_PARTS, RECALL = 8192, 1024, 10, 4096, 32, 256, 0.97
#: Vectors and queries that meet in one task, at most.
BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Router:
    """Network of one hidden layer; ``probes`` parts are searched."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def nearest(x: np.ndarray, base: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the k largest products in ``base``, without base row skip[i] for row i."""
    out = []
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ base.T
        if skip is not None:
            s[np.arange(len(s)), skip[lo : lo + 512]] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """2**depth parts of equal size: each half is a median cut along the second eigenvector of the walk on the graph inside it."""
    n, k = graph.shape
    src, dst = np.repeat(np.arange(n), k), graph.reshape(-1)
    src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
    part = np.zeros(n, np.int64)
    for _ in range(depth):
        new = part * 2
        inside = part[src] == part[dst]
        s, d = src[inside], dst[inside]
        weight = np.bincount(s, minlength=n) + 1.0
        sizes, totals = np.bincount(part), np.bincount(part, weight)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = (v + np.bincount(s, v[d], n)) / weight
            v -= (np.bincount(part, v * weight) / totals)[part]
            v /= np.sqrt(np.bincount(part, v * v) / sizes + 1e-30)[part]
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - (np.cumsum(sizes) - sizes)[part[order]]
        new[rank >= sizes[part] // 2] += 1
        part = new
    return part


def fit_router(x: np.ndarray, n_rows: int, k: int = 5, seed: int = 7) -> Router:
    """Fit on unit vectors ``x``, a sample of n_rows."""
    rng = np.random.default_rng(seed)
    depth, size = 0, min(PART, max(LEAST_PART, n_rows // 16))
    while (1 << depth) * size < n_rows and (1 << depth) < MAX_PARTS and len(x) >= (1 << depth) * 16:
        depth += 1
    parts = 1 << depth
    dims = x.shape[1]
    if parts == 1 or len(x) < 64:
        return Router(np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held = rng.permutation(len(x)) < min(HELD_OUT, len(x) // 4)
    train = x[~held]
    graph = nearest(train, train, min(DEGREE, len(train) - 1), np.arange(len(train)))
    part = balanced_parts(graph, depth, rng)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph].reshape(-1)), 0.5 / graph.shape[1])
    target[np.arange(len(train)), part] += 0.5
    hidden = 64
    weights = [rng.standard_normal((dims, hidden)) * (2 / np.sqrt(dims)), np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.1, np.zeros(parts)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(25):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), 128):
            rows = order[lo : lo + 128]
            a = np.tanh(train[rows] @ weights[0] + weights[1])
            z = a @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            ga = (g @ weights[2].T) * (1 - a * a)
            step += 1
            for j, grad in enumerate((train[rows].T @ ga, ga.sum(0), a.T @ g, g.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.99 * v[j] + 0.01 * grad * grad
                weights[j] -= 0.01 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    router = Router(*weights, probes=parts)
    home = router.scores(train).argmax(axis=1)
    found = home[nearest(x[held], train, min(k, len(train)))]
    ranked = np.argsort(-router.scores(x[held]), axis=1)
    position = np.empty_like(ranked)
    np.put_along_axis(position, ranked, np.arange(parts)[None, :].repeat(len(ranked), 0), axis=1)
    needed = np.take_along_axis(position, found, axis=1)
    router.probes = next(p for p in range(1, parts + 1) if (needed < p).mean() >= RECALL or p == parts)
    return router


def _route(router: Router | None, main_size: int, many: bool):
    """Add part: the most probable one, or for ``many`` one row for each probed part. Vectors of an unusual length share part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).to_numpy()
            take, part = [np.flatnonzero(size != main_size)], [np.full((size != main_size).sum(), -1)]
            rows = np.flatnonzero(size == main_size)
            for lo in range(0, len(rows), 2048):
                some = rows[lo : lo + 2048]
                s = router.scores(units(matrix(b.column(2).take(pa.array(some)))))
                ranked = np.argsort(-s, axis=1, kind="stable")[:, : router.probes if many else 1]
                take.append(np.repeat(some, ranked.shape[1])), part.append(ranked.reshape(-1))
            picked = b.take(pa.array(np.concatenate(take).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(part).astype(np.int32))], names=["vec_id", "size", "embedding", "part"])

    return run


def _rerank(k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        qid, vid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, x = units(matrix(left.column("embedding"))), units(matrix(right.column("embedding")))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(q), 256):
            s = q[lo : lo + 256] @ x.T
            s[qid[lo : lo + 256][:, None] == vid[None, :]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -3.0)
            for i in range(len(s)):
                near = np.flatnonzero(s[i] >= max(least[i], -2.5) - 1e-9)
                exact = (x[near] * q[lo + i]).sum(axis=1)  # one order of summation, so that equal vectors tie exactly
                best = np.lexsort((vid[near], -exact))[:k]
                out.append((np.full(len(best), qid[lo + i]), vid[near][best], exact[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    return run


def _search(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Top k of each query among the vectors of the parts it was sent to, and of its own length."""
    sizes = base.groupBy("part", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(queries.groupBy("part", "size").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")), ["part", "size"])
    sizes = materialize(sizes, "blocks")
    left = queries.join(sizes, ["part", "size"]).select(
        "part", "size", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "embedding",
    )
    right = base.join(sizes, ["part", "size"]).select(
        "part", "size", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"),
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding",
    )
    keys = ["part", "size", "query_block", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by cosine in double precision, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own. All rows are indexed; only the index is fitted on a hash sample of about FIT_ROWS rows. A
    query that finds fewer than k in its parts is searched again in all of them, so it gets fewer
    only where there are not k candidates.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no
    part; vectors compare only with vectors of their own length; rows without an id are left out;
    rows that repeat an id count as one (the least vector); an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", F.size("embedding").alias("size"), "embedding"), "vectors")
    common = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    main_size, n_rows = (common["size"], common["count"]) if common else (0, 0)
    share = min(1.0, FIT_ROWS / max(1, n_rows))
    sample = rows.where((F.col("size") == main_size) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * FIT_ROWS).select("embedding").toArrow()
    router = fit_router(units(matrix(sample.column(0))), n_rows, k) if len(sample) else None
    schema = "vec_id long, size int, embedding array<double>, part int"
    base = materialize(rows.mapInArrow(_route(router, main_size, False), schema), "index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = materialize(_search(materialize(asked.mapInArrow(_route(router, main_size, True), schema), "queries"), base, k), "found")
    few = materialize(asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "few")
    if few.isEmpty():
        return found
    everywhere = few.join(base.select("part", F.col("size").alias("s")).distinct().where("part >= 0").unionByName(base.where("part < 0").select("part", F.col("size").alias("s")).distinct()), F.col("size") == F.col("s")).select("vec_id", "size", "embedding", "part")
    again = _search(materialize(everywhere, "everywhere"), base, k)
    return found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
