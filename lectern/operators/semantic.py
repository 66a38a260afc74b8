"""Semantic index of passages: embedding, incremental build by watermark and fingerprint, exact search with provenance.

An index is a folder of Parquet tables written in runs. A run writes only what changed: chunks (with their page
labels) and fingerprints (with the alignment of pages) of changed items, and tombstones of vanished ones; its row in
``meta`` is written last and makes it valid. Readers take the newest valid run of each key, so an update costs what changed, a
run that failed half-way is overwritten, and searching writes nothing.

A compaction is a run that holds all of the index: it is written like any other, and its row in ``meta`` makes it the
base, so that readers see the runs before it or it alone, never both. ``vacuum`` then deletes the folders that no reader needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import index, pages, vectors
from lectern.storage import materialize


@dataclass(frozen=True)
class Embedder:
    """A model: its name, its vectors' length, and a function from texts to a float32 matrix with unit rows."""

    name: str
    dim: int
    embed: Callable[[list[str]], np.ndarray]


def character_embedder(dim: int = 64) -> Embedder:
    """Counts of characters by code modulo ``dim``, scaled to length 1; deterministic, without a model file."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            v = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % dim, minlength=dim).astype(np.float64)
            out[k] = v / max(np.sqrt(v @ v), 1e-12)
        return out

    return Embedder(f"characters-{dim}", dim, embed)


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """rows plus embedding, 16 texts at a time as models take them."""
    embed = embedder.embed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            x = [embed(texts[k : k + 16]) for k in range(0, len(texts), 16)]
            x = np.concatenate(x) if x else np.zeros((0, 1), np.float32)
            offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=[*b.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>")


def latest(spark: SparkSession, folder: str):
    """The newest valid run's row (run, runs, model, dim, watermark, stored_at), or None; runs are the ones that readers need."""
    try:
        return spark.read.parquet(f"{folder}/meta").orderBy(F.desc("run")).first()
    except AnalysisException:
        return None


def _runs(spark: SparkSession, folder: str, name: str, meta) -> DataFrame:
    """Rows of the valid runs of a table; the runs are folders, so others are not even listed as input."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/run={r}" for r in meta["runs"]]).withColumn("run", F.col("run").cast("long"))


def items(spark: SparkSession, folder: str, meta) -> DataFrame:
    """(key, run, content_hash, n_chunks, alignment) of the items in the index."""
    newest = _runs(spark, folder, "items", meta).groupBy("key").agg(F.max_by(F.struct("run", "content_hash", "n_chunks", "alignment", "deleted"), "run").alias("r")).select("key", "r.*")
    return newest.where("not deleted").drop("deleted")


def passages(spark: SparkSession, folder: str, meta=None) -> DataFrame:
    """Chunks with embeddings and page labels of the items in the index.

    Only what later runs replaced is looked up (as an anti-join against a list that is small after a compaction), so
    chunks are not shuffled.
    """
    meta = meta or latest(spark, folder)
    rows = _runs(spark, folder, "chunks", meta)
    if len(meta["runs"]) == 1:
        return rows
    seen = _runs(spark, folder, "items", meta)
    last = seen.groupBy("key").agg(F.max("run").alias("last"))
    stale = seen.join(last, "key").where((F.col("run") < F.col("last")) & ~F.col("deleted")).select("key", "run")
    return rows.join(stale, ["key", "run"], "left_anti")


def _commit(spark: SparkSession, folder: str, run: int, runs: list[int], embedder: Embedder, watermark: int) -> None:
    """The row of ``meta`` that makes a run valid: one file, written last."""
    row = [(run, runs, embedder.name, embedder.dim, watermark)]
    rows = spark.createDataFrame(row, "run long, runs array<long>, model string, dim int, watermark long").withColumn("stored_at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/meta")


def update(
    folder: str, texts: DataFrame, manifest: DataFrame, embedder: Embedder, max_tokens: int = 128, rebuild: bool = False, separator: str = "\f", compact_after: int = 16
) -> dict[str, int]:
    """Bring the index up to date with texts (key, text and, where known, pages and labels) and manifest (key, version); counts of what was done.

    Only items newer than the watermark are read, only those whose fingerprint changed are embedded.
    Another model or vector length starts the index anew. An item whose text became empty leaves
    the index. The watermark never passes an item of the manifest whose text was not delivered. Chunks get the label of
    the page they begin on, as ``pages.labelled_chunks`` does. From ``compact_after`` runs on, the index is compacted.
    """
    spark = texts.sparkSession
    meta = latest(spark, folder)
    fits = meta is not None and not rebuild and (meta["model"], meta["dim"]) == (embedder.name, embedder.dim)
    run = meta["run"] + 1 if meta is not None else 1
    watermark = meta["watermark"] if fits else 0
    manifest = manifest.select(F.col("key").cast("string").alias("key"), "version")
    newer = index.since(manifest, watermark)
    known = lambda c, kind: F.col(c).cast(kind) if c in texts.columns else F.lit(None).cast(kind)
    delivered = texts.select(F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text"), known("pages", "int").alias("pages"), known("labels", "array<string>").alias("labels"))
    read = delivered.join(newer.select("key"), "key", "left_semi")
    chunks = materialize(pages.labelled_chunks(pages.chunk(read, max_tokens), read, separator), "chunks")
    prints = pages.fingerprint(chunks)
    nowhere = spark.createDataFrame([], "key string, run long, content_hash string, n_chunks long, alignment string")
    stored = materialize(items(spark, folder, meta) if fits else nowhere, "stored")
    changed = materialize(index.changed(prints, stored), "changed")
    emptied = stored.select("key").join(newer, "key", "left_semi").join(prints, "key", "left_anti")
    gone = materialize(index.vanished(stored, manifest).unionByName(emptied).distinct(), "gone")
    aligned = pages.page_table(read, separator).where("page = 0").select("key", F.col("status").alias("alignment"))
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = changed.join(aligned, "key", "left").withColumn("deleted", F.lit(False))
    rows = rows.unionByName(gone.select("key", nothing("string").alias("content_hash"), nothing("long").alias("n_chunks"), nothing("string").alias("alignment"), F.lit(True).alias("deleted")))
    embedded(chunks.join(changed.select("key"), "key", "left_semi"), embedder).write.mode("overwrite").parquet(f"{folder}/chunks/run={run}")
    rows.write.mode("overwrite").parquet(f"{folder}/items/run={run}")
    undelivered = newer.join(delivered.select("key"), "key", "left_anti")
    mark = index.next_watermark(manifest, undelivered, watermark).first()[0]
    _commit(spark, folder, run, [*meta["runs"], run] if fits else [run], embedder, mark)
    if fits and len(meta["runs"]) + 1 >= compact_after:
        compact(spark, folder, embedder)
    n_changed, n_read = changed.count(), prints.count()
    return {"embedded": n_changed, "skipped": n_read - n_changed, "removed": gone.count(), "run": run}


def compact(spark: SparkSession, folder: str, embedder: Embedder) -> int:
    """Write the index as one run, in the order of its keys, and make that the only valid one; its number. Nothing is embedded again.

    Readers that began before go on with the old runs, which stay until ``vacuum``.
    """
    meta = latest(spark, folder)
    run = meta["run"] + 1
    rows = passages(spark, folder, meta).drop("run")
    rows.repartitionByRange("key", "idx").sortWithinPartitions("key", "idx").write.mode("overwrite").parquet(f"{folder}/chunks/run={run}")
    items(spark, folder, meta).drop("run").withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/items/run={run}")
    _commit(spark, folder, run, [run], embedder, meta["watermark"])
    return run


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Delete the run folders that the newest state does not read; their paths. Call it when no reader of an older state is left."""
    keep = {f"run={r}" for r in latest(spark, folder)["runs"]}
    jvm, gone = spark.sparkContext._jvm, []
    for name in ("chunks", "items"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            found = status.getPath()
            if found.getName().startswith("run=") and found.getName() not in keep and fs.delete(found, True):
                gone.append(f"{name}/{found.getName()}")
    return sorted(gone)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: what the index holds and since when, how its pages are aligned, and why labels are missing or estimated.

    items, chunks, precise, estimated, unlabelled, model, dim, watermark, runs, stored_at, and degraded: the alignments other than ok with
    the number of their items, most frequent first. Without an index the counts are 0 and degraded says so.
    """
    meta = latest(spark, folder)
    if meta is None:
        return spark.createDataFrame([(0, 0, 0, 0, 0, None, None, None, 0, None, ["there is no index"])], "items long, chunks long, precise long, estimated long, unlabelled long, model string, dim int, watermark long, runs int, stored_at timestamp, degraded array<string>")
    facts = [F.lit(meta["model"]).alias("model"), F.lit(meta["dim"]).alias("dim"), F.lit(meta["watermark"]).cast("long").alias("watermark")]
    why = items(spark, folder, meta).where("alignment <> 'ok'").groupBy("alignment").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "alignment", "n")))
    why = why.agg(F.transform(ordered, lambda r: F.concat(r["alignment"], F.lit(": "), r["n"].cast("string"))).alias("degraded"))
    counts = index.status(passages(spark, folder, meta).select("key", "page_label", "estimated"))
    return counts.join(why).select(*counts.columns, *facts, F.lit(len(meta["runs"])).alias("runs"), F.lit(meta["stored_at"]).alias("stored_at"), "degraded")


def search(spark: SparkSession, folder: str, query: str, embedder: Embedder, limit: int = 10, metadata: DataFrame | None = None) -> DataFrame:
    """Nearest passages: key, idx, text, char_start, char_end, page_label, estimated, score and, where given, the columns of metadata (key, ...).

    Raises ValueError when the query is blank or the index is missing or of another model: the caller
    then searches by words instead.
    """
    if not query.strip():
        raise ValueError("the query is empty")
    meta = latest(spark, folder)
    if meta is None:
        raise ValueError("there is no index")
    if (meta["model"], meta["dim"]) != (embedder.name, embedder.dim):
        raise ValueError(f"the index holds vectors of {meta['model']} ({meta['dim']})")
    q = embedder.embed([query])[0].tolist()
    rows = passages(spark, folder, meta).withColumn("place", F.concat_ws("/", "key", F.lpad(F.col("idx").cast("string"), 9, "0")))
    hits = vectors.nearest(rows, q, limit, "place").withColumn("score", vectors.score_of(F.col("distance")))
    hits = hits.select("key", "idx", "text", "char_start", "char_end", "page_label", "estimated", "score")
    return hits if metadata is None else hits.join(metadata, "key", "left")
