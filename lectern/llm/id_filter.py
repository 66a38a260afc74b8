"""A filter of fixed size for ids: what may be among given ids is found without a shuffle of the rows that hold texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags of the filter: 8 MB for any input. False positives are left to a later join.
FILTER_BITS = 1 << 26


def bits(ids: DataFrame, col: str) -> DataFrame:
    """(bucket, bits): FILTER_BITS flags of hashed ids, in at most FILTER_BITS / 32768 rows of 4 KB."""
    h = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    return ids.select(h.alias("h")).groupBy(F.shiftright("h", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias("bits"))


def bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """The flags of ``bits`` as bytes."""
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in bits(ids, col).collect():
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def flagged(rows: DataFrame, key: Column, ids: DataFrame, col: str, name: str) -> DataFrame:
    """Rows with a boolean column ``name``: False only where the long ``key`` is null or surely none of ``ids``."""
    h, bucket, flags = (f"{name}_{x}" for x in ("h", "bucket", "bits"))
    table = F.broadcast(bits(ids, col).select(F.col("bucket").alias(bucket), F.col("bits").alias(flags)))
    out = rows.withColumn(h, F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))))
    out = out.join(table, F.shiftright(h, 15) == F.col(bucket), "left")
    bit = F.expr(f"shiftright(cast(conv(hex(substring({flags}, cast(shiftright({h} & 32767, 3) as int) + 1, 1)), 16, 10) as int), cast({h} & 7 as int)) & 1")
    return out.withColumn(name, F.coalesce(bit, F.lit(0)) == 1).drop(h, bucket, flags)
