"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize


def _with_minimum(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Add to each (u, v) the least of u and all its partners, as m.

    Minima come from a combinable aggregate, never from collected lists. A node with more than
    1/1000 of the pairs is hot: there are at most 1000 of those, so they are broadcast and
    their pairs stay where they are instead of meeting in one task.
    """
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    least = materialize(least, "component-minima")
    floor = max(1000, n_pairs // 1000)
    hot = F.broadcast(least.where(F.col("degree") > floor).select("u", "m"))
    cool = least.where(F.col("degree") <= floor).select("u", "m")
    return pairs.join(hot, "u").unionByName(pairs.join(hot.select("u"), "u", "left_anti").join(cool, "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the least id reachable from id.

    ``edges`` is an undirected edge table; self loops and repeated edges are harmless, nulls are
    ignored, and an empty table gives an empty result. Only nodes that touch an edge appear.
    Alternating large-star and small-star steps (Kiveris et al., 2014): each round hooks every
    node to the least node around it, so path lengths shrink geometrically and the table never
    holds more than the original number of edges. Each round is written to the shared folder.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    e = materialize(e, "component-edges")
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    loops = e.where("hi = lo").select("hi", "lo")
    e = e.where("hi <> lo")
    for _ in range(max_rounds):
        n = state[0]
        if not n:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        large = _with_minimum(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "component-large")
        small = _with_minimum(large, n)
        small = (
            small.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .where("hi <> lo")
            .distinct()
        )
        e = materialize(small, "component-edges")
        before, state = state, e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if tuple(before) == tuple(state):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    alone = loops.select(F.col("hi").alias("id"), F.col("hi").alias("component"))
    return leaves.unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
