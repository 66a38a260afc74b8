"""A stateful stream of text fingerprints: what changed, by keyed state that holds each key's newest version.

Input are deliveries (key, version, text); a null or blank text takes the key away. State holds the newest version, its
fingerprint and whether the key is gone, so that repeated and late deliveries do nothing, and a newer version of the same text is no
change. State is that of a streaming aggregate, kept by Spark in its checkpoint: a stream that stops goes on where it was. What a
batch changed is found by a join with the log of changes, which each batch reads (keys and hashes, no texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.pages import chunk_spans

DELIVERY = "key string, version long, text string"
CHANGE = "key string, version long, action string, content_hash string, n_chunks long"
_PRINT = "key string, version long, content_hash string, n_chunks long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def text_fingerprints(texts: DataFrame, max_tokens: int = 128) -> DataFrame:
    """(key, version, content_hash, n_chunks) of (key, version, text), row by row: ``pages.fingerprint`` of the text's chunks, null without any."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = [], []
            for text in b.column(2).to_pylist():
                chunks = [digest(text[s:e]) for s, e, _ in chunk_spans(text or "", max_tokens)]
                hashes.append(digest("|".join(chunks)) if chunks else None)
                counts.append(len(chunks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.string()), pa.array(counts, pa.int64())], names=["key", "version", "content_hash", "n_chunks"])

    return texts.select(F.col("key").cast("string").alias("key"), F.col("version").cast("long").alias("version"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PRINT)


def newest(deliveries: DataFrame, max_tokens: int = 128) -> DataFrame:
    """(key, version, content_hash, n_chunks) of a stream of deliveries: the newest version of each key that a batch delivers, by a stateful aggregate. Rows without key or version are left out.

    Of equal versions the one of the earlier batch stays (by the batches' times, which Spark keeps in the checkpoint), of one batch the first in the order
    of their hashes. A key that is gone has the hash '' and keeps its version, so that late deliveries do not bring it back.
    """
    prints = text_fingerprints(deliveries.where("key is not null and version is not null"), max_tokens)
    order = F.struct(F.bitwise_not("version").alias("against"), F.current_timestamp().alias("arrived"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), "n_chunks")
    first = prints.select("key", order.alias("o")).groupBy("key").agg(F.min("o").alias("o"))
    return first.select("key", F.bitwise_not("o.against").alias("version"), "o.content_hash", "o.n_chunks")


def changes(now: DataFrame, logged: DataFrame) -> DataFrame:
    """CHANGE rows of a batch of ``newest``, held against the last change of each key: added, changed or removed keys.

    A delivery at most as new as the version known leaves ``newest`` as it was, whose hash is then that of the key's last change: no change.
    """
    before = _last(logged).select("key", F.coalesce("content_hash", F.lit("")).alias("before"))
    rows = now.join(before, "key", "left").withColumn("before", F.coalesce("before", F.lit(""))).where("content_hash <> before")
    action = F.when(F.col("content_hash") == "", "removed").when(F.col("before") == "", "added").otherwise("changed")
    return rows.select("key", "version", action.alias("action"), F.nullif("content_hash", F.lit("")).alias("content_hash"), "n_chunks")


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    """CHANGE rows with the batch they came in; none where there is no log yet."""
    try:
        return spark.read.schema(f"{CHANGE}, batch long").option("basePath", folder).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{CHANGE}, batch long")


def _last(logged: DataFrame) -> DataFrame:
    """The last change of each key; versions rise from change to change."""
    return logged.groupBy("key").agg(F.max_by(F.struct("version", "action", "content_hash", "n_chunks"), "version").alias("r")).select("key", "r.*")


def maintain(spark: SparkSession, source: str, folder: str, checkpoint: str, max_tokens: int = 128, files_per_batch: int = 64) -> StreamingQuery:
    """Read the Parquet files of DELIVERY that are new under ``source`` and write their changes to ``folder``, a folder a batch; stops when all are read.

    A batch that is written again, after a failure, replaces itself: it is held against the batches before it only.
    """
    def write(rows: DataFrame, batch: int) -> None:
        changes(rows, _logged(rows.sparkSession, folder).where(F.col("batch") < batch)).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, _ROCKSDB)  # keys that outgrow an executor's memory; the query keeps what it started with
    try:
        stream = spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        return newest(stream, max_tokens).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(key, version, content_hash, n_chunks) of the keys that are there: the last change of each. version is that of its last change."""
    return _last(_logged(spark, folder)).where("action <> 'removed'").drop("action")
