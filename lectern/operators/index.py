"""Incremental index maintenance: what changed since a watermark, what vanished, and the state after a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since(manifest: DataFrame, watermark: int) -> DataFrame:
    """Rows of (key, version) newer than the watermark; the filter reaches the scan."""
    return manifest.where(F.col("version") > watermark)


def next_watermark(manifest: DataFrame, unprocessed: DataFrame, floor: int) -> DataFrame:
    """One row: the watermark after a run. It never falls, and never passes an item that was not processed."""
    seen = manifest.agg(F.max("version").alias("seen"))
    left = unprocessed.agg(F.min("version").alias("open"))
    return seen.join(left).select(F.greatest(F.lit(floor), F.coalesce(F.least("seen", F.col("open") - 1), F.lit(floor))).alias("watermark"))


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, content_hash, n_chunks) of current that are new or differ from stored by hash or count."""
    s = stored.select("key", F.col("content_hash").alias("s_hash"), F.col("n_chunks").alias("s_count"))
    same = F.col("content_hash").eqNullSafe(F.col("s_hash")) & F.col("n_chunks").eqNullSafe(F.col("s_count"))
    return current.join(s, "key", "left").where(~same).select(*current.columns)


def vanished(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keys stored but no longer in the full manifest."""
    return stored.join(manifest, "key", "left_anti").select("key")


def merged(stored: DataFrame, updates: DataFrame, manifest: DataFrame) -> DataFrame:
    """The stored rows after a run: updated keys replaced, vanished keys gone."""
    kept = stored.join(updates.select("key").distinct(), "key", "left_anti").join(manifest.select("key").distinct(), "key", "left_semi")
    return kept.unionByName(updates)


def status(chunks: DataFrame) -> DataFrame:
    """One row: items, chunks, and chunks with exact, estimated and no page labels."""
    return chunks.agg(
        F.count_distinct("key").alias("items"), F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("page_label").isNotNull() & ~F.col("estimated")).alias("precise"),
        F.count_if(F.col("page_label").isNotNull() & F.col("estimated")).alias("estimated"), F.count_if(F.col("page_label").isNull()).alias("unlabelled"),
    )
