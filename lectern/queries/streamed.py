"""Queries of streams: the state that deliveries of documents leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.queries import query, table
from lectern.queries.index import _CHUNKS
from lectern.storage import shared_dir
from lectern.streaming import fingerprints


@query(
    f"""WITH RECURSIVE {_CHUNKS}, f AS (SELECT key, substr(sha256(string_agg(substr(sha256(text), 1, 16), '|' ORDER BY idx)), 1, 16) AS content_hash, count(*) AS n_chunks FROM chunks GROUP BY 1)
SELECT CAST(key AS VARCHAR) AS key, CAST(CASE WHEN key % 3 = 1 THEN 3 ELSE 1 END AS BIGINT) AS version, content_hash, n_chunks FROM f WHERE key % 7 <> 2"""
)
def fingerprint_stream(spark, sf_dir):
    """Three deliveries, the last after a restart: texts, then newer versions of a third and of a seventh that goes, then late and repeated ones."""
    place = f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "text")
    row = lambda rows, version, text: rows.select(d.cast("string").alias("key"), F.lit(version).cast("long").alias("version"), text.alias("text"))
    gone, late, text = d % 7 == 2, d % 3 == 1, F.col("text")
    first = row(docs, 1, F.when(late, F.concat("text", F.lit(" of old"))).otherwise(text))
    second = row(docs.where(late & ~gone), 3, text).unionByName(row(docs.where(gone), 4, F.lit(None).cast("string"))).unionByName(row(docs.where(~late & ~gone), 2, text))
    third = row(docs.where(gone), 3, text).unionByName(row(docs.where(late), 2, F.concat("text", F.lit(" late")))).unionByName(row(docs.where(~gone & late), 3, text))
    for deliveries in ((first, second), (third,)):
        for rows in deliveries:
            rows.write.mode("append").parquet(f"{place}/in")
            fingerprints.maintain(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return fingerprints.fingerprints(spark, f"{place}/out")
