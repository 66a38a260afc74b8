"""Dense numbers, merged exports and files in order."""

import glob
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.operators import assembly
from lectern.operators.numbering import numbered, numbered_within


def test_numbers_are_dense_and_in_order(spark):
    r = random.Random(3)
    rows = [(r.choice("aaaab"), r.randint(0, 50), k) for k in range(3000)] + [(None, 1, 3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(6)
    got = {x["id"]: x["number"] for x in numbered(df, [F.col("x"), F.col("id")]).collect()}
    assert got == {row[2]: k for k, row in enumerate(sorted(rows, key=lambda row: row[1:]))}
    inside = {x["id"]: x["number"] for x in numbered_within(df, ["g"], [F.col("x").desc(), F.col("id")]).collect()}
    for g in ("a", "b", None):
        mine = sorted((row for row in rows if row[0] == g), key=lambda row: (-row[1], row[2]))
        assert [inside[row[2]] for row in mine] == list(range(len(mine)))
    assert numbered(df.limit(0), [F.col("x")]).count() == 0 and numbered_within(df.limit(0), ["g"], [F.col("x")]).count() == 0


def export(spark, path, keys, parts, kind):
    rows = assembly.merged(spark.createDataFrame(keys, "ord int, key string"), spark.createDataFrame(parts, "key string, body string"), kind)
    assembly.write_in_order(rows, path)
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_merged_files(spark, tmp_path):
    keys = [(k, f" k{k} ") for k in range(500, 0, -1)] + [(-1, "k7"), (600, "k7"), (0, " "), (0, "absent")]
    parts = [(f"k{k}", json.dumps([{"id": k, "t": "a\n,]"}, {"id": -k}]) if k % 3 else f' {{"id": {k}}}\n') for k in range(500, -1, -1)]
    merged = json.loads(export(spark, str(tmp_path / "json"), keys, parts, "csljson"))
    order = [7] + [k for k in range(1, 501) if k != 7]
    assert [e["id"] for e in merged] == [i for k in order for i in ([k, -k] if k % 3 else [k])] and merged[0]["t"] == "a\n,]"
    texts = [("k1", "\n@a{x}\n\n"), ("k2", "  "), ("k3", "@b{y,\n}")]
    assert export(spark, str(tmp_path / "bib"), [(3, "k1"), (2, "k2"), (1, "k3")], texts, "bibtex") == "@b{y,\n}\n\n@a{x}\n"
    assert json.loads(export(spark, str(tmp_path / "none"), [(1, "x")], texts, "csljson")) == []
    assert export(spark, str(tmp_path / "empty"), [(1, "x")], texts, "ris") == ""
    with pytest.raises(AnalysisException):
        export(spark, str(tmp_path / "bib"), [(1, "k1")], texts, "bibtex")
