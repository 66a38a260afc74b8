"""Token counts: an exact histogram of encoded lengths, whose prefix and suffix sums answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.byte_tokens import token_counts
from lectern.storage import materialize

#: Lengths in one window partition: sums run inside such blocks, over blocks only totals are summed.
BLOCK = 4096


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, all of them."""
    return token_counts(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """One row per occurring length n, read as a context limit.

    n_tokens, n_docs, docs_up_to (documents that fit), docs_over (that get cut), quantile (share that
    fits), tokens_up_to (tokens of those that fit), total_tokens (of all), truncated_tokens (tokens
    left when every document is cut at n) and lost_tokens. A limit between two lengths answers like
    the next smaller row: truncated_tokens + docs_over * (limit - n). An empty histogram gives no rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = (
        h.join(totals, "block")
        .withColumn("docs_up_to", F.col("docs_before") + F.sum("n_docs").over(inside))
        .withColumn("tokens_up_to", F.col("tokens_before") + F.sum("tokens").over(inside))
        .withColumn("docs_over", F.col("all_docs") - F.col("docs_up_to"))
        .withColumn("truncated_tokens", F.col("tokens_up_to") + F.col("docs_over") * F.col("n_tokens"))
    )
    return up.select(
        "n_tokens", "n_docs", "docs_up_to", "docs_over", (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"), "tokens_up_to", "total_tokens", "truncated_tokens",
        (F.col("total_tokens") - F.col("truncated_tokens")).alias("lost_tokens"),
    )


def token_length_limits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``limits`` of the documents' histogram; null text counts as a document of 0 tokens, ids do not matter."""
    return limits(materialize(length_histogram(docs, path), "lengths"))
