"""Dense numbers and running totals over a whole table in a given order, without one task or one window for all rows.

The table is range-partitioned and sorted, each partition is totalled, and the totals before a partition (a row
a partition) are added to what is counted inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import materialize

#: Bits that a row's place inside its partition takes in Spark's increasing ids.
_PLACE_BITS = 33


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _part and _place: the range of the order that a row lies in, and its place there."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    at = F.col("_id")
    return materialize(ordered.withColumn("_part", F.shiftright(at, _PLACE_BITS)).withColumn("_place", at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_id"), "ordered")


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """rows plus ``name``: 0, 1, 2, ... in ``order``, without gaps; rows equal in ``order`` are numbered in any order.

    An empty table stays empty. Rows equal in the order share a range: where many may be equal, let the order end
    with a column that tells them apart.
    """
    placed = _placed(rows, order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def numbered_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """rows plus ``name``: 0, 1, 2, ... inside each group, in ``order``; a group of any size is spread over as many tasks as its rows need."""
    dense = numbered(rows, [*[F.col(g).asc_nulls_first() for g in group], *order], "_dense")
    dense = materialize(dense, "dense")
    first = dense.groupBy(*group).agg(F.min("_dense").alias("_first"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    first = first.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_first")
    # a group's first number lies in its first row, which the group's rows look up; AQE splits a group that is hot
    return dense.join(first, same).withColumn(name, F.col("_dense") - F.col("_first")).drop("_dense", "_first", *[f"_g_{g}" for g in group])
