"""Containment joins, many-query neighbours and chunks by pieces held against brute force."""

import random

import numpy as np

from lectern.operators import containment, vectors


def test_containing_equals_brute_force(spark):
    r = random.Random(6)
    letters = "ab日é \n"
    texts = [(k, "".join(r.choices(letters, k=r.randint(0, 120)))) for k in range(150)] + [(900, "😀😀 x" * 30), (901, None), (902, "")] + [(k, "the same text") for k in range(1000, 1200)]
    strings = [(k, "".join(r.choices("ab日é ", k=r.randint(0, 9)))) for k in range(120)] + [(k, texts[k][1][5:30]) for k in range(120, 150)] + [(500, "😀 😀x😀😀x"), (501, None), (502, " \n"), (503, "th e sam"), (504, "same text"), (503, "a")]
    got = containment.containing(spark.createDataFrame(strings, "id long, value string"), spark.createDataFrame(texts, "id long, value string"), 6)
    squeeze = lambda t: "".join((t or "").split())
    expected = sorted((s, t) for s, a in strings for t, b in texts if squeeze(a) and squeeze(a) in squeeze(b))
    assert sorted(map(tuple, got.select("string_id", "text_id").collect())) == expected
    nothing = spark.createDataFrame([], "id long, value string")
    assert containment.containing(nothing, nothing).count() == 0


def test_nearest_many_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[10]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None] * 4)]
    asked = [(k, x[k].tolist()) for k in (0, 10, 55, 200)] + [(402, [1.0, 2.0]), (999, (x[3] + 5).tolist()), (998, None)]
    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    got = vectors.nearest_many(spark.createDataFrame(rows, "id long, embedding array<float>"), spark.createDataFrame(asked, "query_id long, embedding array<float>"), 7).collect()
    found = {}
    for h in sorted(got, key=lambda h: (h["query_id"], h["rank"])):
        found.setdefault(h["query_id"], []).append((h["id"], round(h["distance"], 9)))
    for q, v in asked[:4] + asked[5:6]:
        d = np.sqrt(((x.astype(float) - np.array(v)) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((np.arange(len(d)), d)) if k != q][:7]
        assert found[q] == [(k, round(float(d[k]), 9)) for k in order]
    assert set(found) == {0, 10, 55, 200, 999}
