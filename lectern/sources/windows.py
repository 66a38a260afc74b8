"""Beginnings and ends of files: what recognising a file needs, without reading it whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's beginning and of its end.
HEAD, TAIL = 256 << 10, 64 << 10
_SCHEMA = "path string, length long, modified timestamp, head binary, tail binary, error string"


def _ranges(head: int, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails, errors = [], [], []
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = last = error = None
                try:
                    system, place = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path).replace(" ", "%20"))
                    with system.open_input_file(place) as f:
                        first = f.read_at(min(head, length), 0)
                        rest = min(tail, length - len(first))
                        last = f.read_at(rest, length - rest) if rest > 0 else b""
                except (OSError, pa.ArrowException) as e:
                    error = type(e).__name__
                heads.append(first), tails.append(last), errors.append(error)
                if len(heads) >= 64:  # at most some 20 MB at once
                    yield _batch(b, heads, tails, errors, path_count=len(heads))
                    b = b.slice(len(heads))
                    heads, tails, errors = [], [], []
            if heads:
                yield _batch(b, heads, tails, errors, path_count=len(heads))

    return run


def _batch(b: pa.RecordBatch, heads: list, tails: list, errors: list, path_count: int) -> pa.RecordBatch:
    columns = [c.slice(0, path_count) for c in b.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), pa.array(errors, pa.string())], names=["path", "length", "modified", "head", "tail", "error"])


def file_windows(spark: SparkSession, location: str, pattern: str = "*", head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """(path, length, modified, head, tail, error): the first and last bytes of every file under a folder or glob, folders below included.

    Spark lists the files (their contents are no column that is asked for, so it opens none) and deals them out to tasks, which read two
    ranges of each. head is the first bytes, tail the last ones that are not in head: a short file is whole in both together. A file that is gone or
    cannot be read has an error and no bytes; files without bytes are not listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(location)
    rows = found.select("path", "length", F.col("modificationTime").alias("modified")).repartition("path")
    return rows.mapInArrow(_ranges(head, tail), _SCHEMA)


def window_text(windows: DataFrame) -> DataFrame:
    """windows plus text: head and tail as one character a byte, with a line between them, as recognising embedded metadata wants it."""
    part = lambda c: F.decode(F.coalesce(F.col(c), F.lit(b"")), "ISO-8859-1")
    return windows.withColumn("text", F.concat_ws("\n", part("head"), F.when(F.octet_length("tail") > 0, part("tail"))))
