"""Incremental maintenance of a passage index from a stream of text versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import pages

SCHEMA = "key string, version long, text string"


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each key: a combinable aggregate."""
    return rows.groupBy("key").agg(F.max_by(F.struct("version", "text"), "version").alias("r")).select("key", "r.version", "r.text")


def apply_batch(batch: DataFrame, batch_id: int, folder: str, max_tokens: int = 128) -> None:
    """Chunk the batch's newest texts into ``folder``/batch=<id>; writing a batch again replaces it, so retries are harmless."""
    fresh = latest(batch)
    chunks = pages.chunk(fresh, max_tokens).join(fresh.select("key", "version"), "key")
    chunks.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the newest version of every key over all batches; an empty text leaves none."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest = rows.groupBy("key").agg(F.max(F.struct("version", "batch")).alias("n")).select("key", "n.*")
    return rows.join(newest, ["key", "version", "batch"])


def maintain(spark: SparkSession, source: str, folder: str, checkpoint: str, max_tokens: int = 128) -> StreamingQuery:
    """Read new Parquet files of SCHEMA under ``source`` and keep the index in ``folder``; stops when all are read."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    write = stream.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, folder, max_tokens))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
