"""Exact nearest neighbours by distance, scores, pooling and retrieval metrics over embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Rows and queries of one block, and distances that are held at once.
ROWS, QUERIES, DISTANCES = 8192, 2048, 1 << 20

#: Vectors of up to so many components are averaged by one aggregate a component, longer ones component rows.
WIDE = 512


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length, summed in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def score_of(distance: Column) -> Column:
    """Cosine of unit vectors at a Euclidean distance, held to -1..1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, ties to the smaller id: one scan and a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", l2_distance(F.col(vector_col), q)).orderBy("distance", id_col).limit(max(1, k))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)


def _block_hits(k: int):
    """The k nearest rows of a block for each query of a block, kept in a bounded list a query."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        size = key[0].as_py()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, row, distance
        if rows.num_rows and queries.num_rows:
            x, q = _matrix(rows["vector"], size), _matrix(queries["q_vector"], size)
            ids, asked = rows["id"].to_numpy(), queries["q_id"].to_numpy()
            x2, q2 = (x * x).sum(axis=1), (q * q).sum(axis=1)
            worst = np.full(len(q), np.inf)
            step = max(16, DISTANCES // len(q))
            for lo in range(0, len(x), step):
                part = slice(lo, lo + step)
                squared = x2[part, None] + q2 - 2 * (x[part] @ q.T)
                # products round: what may be near enough is measured again by differences
                i, j = np.nonzero(~(squared > worst**2 + 1e-9 * (1 + x2[part, None] + q2)))
                i += lo
                other = ids[i] != asked[j]
                i, j = i[other], j[other]
                d = np.empty(len(i))
                for a in range(0, len(i), DISTANCES // max(1, size) + 1):
                    b = slice(a, a + DISTANCES // max(1, size) + 1)
                    d[b] = np.sqrt(((x[i[b]] - q[j[b]]) ** 2).sum(axis=1))
                j, i, d = (np.concatenate(p) for p in zip(held, (j, i, d)))
                order = np.lexsort((ids[i], d, j))
                g = j[order]
                order = order[np.arange(len(g)) - np.searchsorted(g, g, "left") < k]
                held = j[order], i[order], d[order]
                full = np.bincount(held[0], minlength=len(q)) >= k
                last = np.zeros(len(q))
                np.maximum.at(last, held[0], held[2])
                worst = np.where(full, last, np.inf)
            held = asked[held[0]], ids[held[1]], held[2]
        return pa.table({"query_id": held[0], "id": held[1], "distance": held[2]})

    return run


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of vectors (id, embedding) nearest to each of queries (query_id, embedding), ties to the smaller id; exact.

    A row is no hit of the query with its own id. Rows and queries are dealt out in blocks, each block of rows meets each block of queries, and only
    k rows a query leave a meeting. Null and empty vectors and those with null components take no part; vectors of different lengths
    never meet.
    """
    good = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull())
    rows = vectors.where(good("embedding")).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("size"))
    asked = queries.where(good("embedding")).select(F.col("query_id").cast("long").alias("q_id"), F.col("embedding").cast("array<double>").alias("q_vector"), F.size("embedding").alias("q_size"))
    count = lambda df, by, most, name: df.groupBy(F.col(by).alias("n_size")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    blocks = F.broadcast(materialize(count(rows, "size", ROWS, "row_blocks").join(count(asked, "q_size", QUERIES, "query_blocks"), "n_size"), "blocks"))  # a row a vector length
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(blocks, F.col("size") == F.col("n_size")).select("id", "vector", "size", deal("id", "row_blocks").alias("rb"), every("query_blocks").alias("qb"))
    right = asked.join(blocks, F.col("q_size") == F.col("n_size")).select("q_id", "q_vector", "q_size", every("row_blocks").alias("q_rb"), deal("q_id", "query_blocks").alias("q_qb"))
    hits = left.groupBy("size", "rb", "qb").cogroup(right.groupBy("q_size", "q_rb", "q_qb")).applyInArrow(_block_hits(k), "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def retrieval_report(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(lang, queries, top1, in_top, unknown_rate, negatives, highest_negative), one row a language.

    queries: query_id, lang, expected (an item, null for a query that nothing answers) and unknown_rate; hits: query_id, rank, item, score. top1
    and in_top are shares of the queries with an expected item; highest_negative is the best score that a query without one got.
    """
    per = hits.join(queries.select("query_id", "expected"), "query_id").groupBy("query_id").agg(
        F.coalesce(F.max((F.col("item") == F.col("expected")) & (F.col("rank") == 1)), F.lit(False)).alias("first"), F.coalesce(F.max(F.col("item") == F.col("expected")), F.lit(False)).alias("among"), F.max("score").alias("best")
    )
    rows = queries.join(per, "query_id", "left")
    real = F.col("expected").isNotNull()
    share = lambda c: F.round(F.count_if(real & F.coalesce(F.col(c), F.lit(False))) / F.count_if(real), 4)
    return rows.groupBy("lang").agg(
        F.count_if(real).alias("queries"), F.when(F.count_if(real) > 0, share("first")).alias("top1"), F.when(F.count_if(real) > 0, share("among")).alias("in_top"), F.round(F.avg("unknown_rate"), 4).alias("unknown_rate"),
        F.count_if(~real).alias("negatives"), F.round(F.max(F.when(~real, F.col("best"))), 4).alias("highest_negative"),
    )


def best_hit_per_item(hits: DataFrame, item: str, score: str, position: str) -> DataFrame:
    """The best-scored hit of each item, the earliest of equals; a combinable aggregate."""
    rest = [c for c in hits.columns if c != item]
    best = hits.groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("b"))
    return best.select(item, "b.*")


def mean_pool(vectors: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """(group, i, v): mean vector of each group scaled to length 1."""
    # vectors are summed inside the partitions first, so that what is shuffled is one vector a group and partition
    names, dims = vectors.schema[group].dataType, vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    x = F.col(vector_col)
    sums = vectors.groupBy(group).agg(*[F.avg(F.get(x, F.lit(k)).cast("double")).alias(f"m{k}") for k in range(dims)]) if dims <= WIDE else None
    if sums is None:
        means = vectors.select(group, F.posexplode(vector_col).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        return means.withColumn("v", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))).select(group, "i", "v")
    m = F.array(*[F.col(f"m{k}") for k in range(dims)])
    norm = F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, v: s + v * v))
    return sums.select(F.col(group).cast(names), F.posexplode(F.transform(m, lambda v: v / norm)).alias("i", "v"))
