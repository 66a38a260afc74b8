"""Each pipeline stage held against its operator on one row at a time or brute force."""

import pytest

import corpus_pipeline
from lectern.llm import ngram_join, pii, quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order_and_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    expected = {
        "quality": lambda d: {r["doc_id"] for r in quality.quality_scores(d, labels).where("predicted = 1").collect()},
        "toxicity": lambda d: {r["doc_id"] for r in toxicity.toxicity_scores(d, labels).where("predicted = 0").collect()},
        "near_duplicates": lambda d: {r["doc_id"] for r in ngram_join.near_duplicates(d).where("kept").collect()},
        "personal_data": lambda d: {r["doc_id"] for r in d.collect()},
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*expected, "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert result.agg({"length": "sum"}).first()[0] == result.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
            assert {r["doc_id"] for r in result.collect()} == {r["doc_id"] for r in docs.collect()}
            continue
        assert result.columns == docs.columns
        assert {r["doc_id"] for r in result.collect()} == expected[name](docs)
        if name == "personal_data":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in result.collect():
                base, added = pii.find(before[r["doc_id"]])
                assert (r["text"] == before[r["doc_id"]]) == (not base and not added) and r["n_chars"] == len(r["text"])
        docs = result


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11)]])
def test_stages_take_awkward_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        n = out.count()
        assert n == 0 if not rows else n >= 0
        if name == "near_duplicates" and rows:
            assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "None"]
