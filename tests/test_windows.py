"""Windows of files: what is read, what is not, and that identification works on it."""

import os
from urllib.parse import unquote

from pyspark.sql import functions as F

from lectern.operators import identify
from lectern.sources.windows import file_windows, window_text


def test_only_windows_are_read(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF-1.4 doi 10.1000/abc. " + b"x" * 74)
    with open(folder / "deep" / "large name.pdf", "wb") as f:  # a hole of 3 GB: reading it whole would not go unnoticed
        f.write(b"H" * 10)
        f.truncate(3 << 30)
        f.seek(0, os.SEEK_END)
        f.write(b"end \xff/Title (A study of windows)")
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"no")
    rows = file_windows(spark, str(folder), "*.pdf", 64, 40)
    got = {unquote(os.path.basename(r["path"])): r for r in rows.collect()}
    assert {k: (r["length"], len(r["head"]), len(r["tail"]), r["error"]) for k, r in got.items()} == {"a.pdf": (100, 64, 36, None), "large name.pdf": ((3 << 30) + 32, 64, 40, None)}
    whole = got["a.pdf"]["head"] + got["a.pdf"]["tail"]
    assert whole == (folder / "a.pdf").read_bytes() and got["large name.pdf"]["tail"].endswith(b"end \xff/Title (A study of windows)")
    texts = {unquote(os.path.basename(r["path"])): r["text"] for r in window_text(rows).collect()}
    assert "\xff/Title" in texts["large name.pdf"]
    files = window_text(rows).select(F.col("path").alias("key"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "text")
    candidates = spark.createDataFrame([], "key string, pos int, title string, doi string")
    found = {unquote(os.path.basename(r["key"])): r["value"] for r in identify.identify(files, candidates).collect()}
    assert found["a.pdf"] == "10.1000/abc" and set(found) == {"a.pdf", "large name.pdf"}
