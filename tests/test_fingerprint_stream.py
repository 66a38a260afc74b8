"""The stateful stream of fingerprints held against a replay of its deliveries and against the batch operators."""

import random

from pyspark.sql import functions as F

from lectern.operators import index, pages
from lectern.streaming import fingerprints


def deliver(spark, place, rows, **more):
    spark.createDataFrame(rows, fingerprints.DELIVERY).coalesce(1).write.mode("append").parquet(f"{place}/in")
    fingerprints.maintain(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint", max_tokens=8, **more).awaitTermination()


def test_fingerprints_of_rows_are_those_of_chunks(spark):
    texts = spark.createDataFrame([("a", 1, "one two. " * 30), ("b", 1, "x"), ("c", 2, " \n"), ("d", 1, None), ("e", 1, "日本 é\n\n" * 20)], fingerprints.DELIVERY)
    rows = {r["key"]: (r["content_hash"], r["n_chunks"]) for r in fingerprints.text_fingerprints(texts, 8).collect()}
    chunked = {r["key"]: (r["content_hash"], r["n_chunks"]) for r in pages.fingerprint(pages.chunk(texts, 8)).collect()}
    assert {k: v for k, v in rows.items() if v[1]} == chunked and rows["c"] == rows["d"] == (None, 0)


def test_restarts_late_and_repeated_deliveries(spark, tmp_path):
    r, place, newest, logged = random.Random(2), str(tmp_path), {}, []
    for batch in range(4):
        rows = [(f"k{r.randint(0, 30)}", r.randint(batch, batch + 6), r.choice(["text one", "text two", "text three " * 9, None, " "])) for _ in range(40)]
        rows = list({(k, v): (k, v, t) for k, v, t in rows}.values()) + [("k1", None, "x"), (None, 3, "x")]
        deliver(spark, place, rows + rows[:5])
        top = {}
        for k, v, t in rows:
            if k is not None and v is not None and v > newest.get(k, (-1,))[0]:
                top[k] = max(top.get(k, (-1, None)), (v, t), key=lambda x: x[0])
        for k, (v, t) in top.items():
            before, now = newest.get(k, (0, None))[1], t if (t or "").strip() else None
            if now != before:
                logged.append((k, v, "removed" if now is None else "changed" if before is not None else "added"))
            newest[k] = (v, now)
    log = spark.read.parquet(f"{place}/out")
    assert sorted((x["key"], x["version"], x["action"]) for x in log.collect()) == sorted(logged)
    there = spark.createDataFrame([(k, v, t) for k, (v, t) in newest.items() if t], fingerprints.DELIVERY)
    batch = pages.fingerprint(pages.chunk(there, 8))
    stored = fingerprints.fingerprints(spark, f"{place}/out").select("key", "content_hash", "n_chunks")
    assert index.changed(batch, stored).count() == 0 and index.vanished(stored, there).count() == 0 and stored.count() == there.count()
    assert log.select(F.count_distinct("batch")).first()[0] == 4


def test_what_is_gone_does_not_come_back_late(spark, tmp_path):
    place = str(tmp_path)
    deliver(spark, place, [("a", 5, "text"), ("b", 5, "text")])
    deliver(spark, place, [("a", 6, None)])
    deliver(spark, place, [("a", 4, "late"), ("b", 4, "late")])
    assert {r["key"] for r in fingerprints.fingerprints(spark, f"{place}/out").collect()} == {"b"}
    assert fingerprints.fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_equal_versions_of_later_batches_change_nothing(spark, tmp_path):
    place, keys = str(tmp_path), [f"k{i}" for i in range(8)]
    deliver(spark, place, [(k, 5, f"first {k}") for k in keys])
    deliver(spark, place, [(k, 6, f"first {k}") for k in keys])  # a newer version of the same text is not logged, but known
    deliver(spark, place, [(k, 6, f"second {k}") for k in keys])
    assert {r["version"] for r in spark.read.parquet(f"{place}/out").collect()} == {5}
    deliver(spark, place, [(k, 7, None) for k in keys] + [(k, 7, f"second {k}") for k in keys])  # of one batch, what is gone comes first
    assert fingerprints.fingerprints(spark, f"{place}/out").count() == 0


def test_state_costs_little_a_key(spark, tmp_path):
    place, n = str(tmp_path), 4000
    for version in (1, 2):
        spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(version).cast("long").alias("version"), F.concat(F.lit(f"text {version} of "), "id").alias("text")).write.mode("append").parquet(f"{place}/in")
        stream = fingerprints.maintain(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint")
        stream.awaitTermination()
        assert sum(p["stateOperators"][0]["allUpdatesTimeMs"] for p in stream.recentProgress if p["numInputRows"]) < 1.5 * n  # task milliseconds
    log = spark.read.parquet(f"{place}/out")
    assert {(r["action"], r["count"]) for r in log.groupBy("action").count().collect()} == {("added", n), ("changed", n)}
