"""Mixing, hard negatives and divergence held against brute force and DuckDB, with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import corpus_sql, divergence, hard_negatives, mixing, term_counts

DOCS = "doc_id long, text string, lang string, source string, size int, u string, h int, n string, term string"


def awkward_documents(n=400, seed=3):
    """Documents with a hot source, null fields, repeated rows, a null id, a long text and columns named like inner ones."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Straße", "ÄRA", "日本語", "x_y", "don't", "A1b"]
    rows = [
        (k, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 40))), r.choice(["en", "en", "de", None, ""]), r.choice(["s1"] * 4 + ["s2", "s3", "日", "é", None, ""]))
        for k in range(n)
    ]
    rows += [(n, None, "en", "s2"), (n + 1, "\t \v\n", "fr", None), (None, "one two", "en", "s1"), (None, "one two", "en", "s1"), (n + 2, "big " * 20000, "en", "s3"), rows[0], rows[0]]
    return [(*row, 1, "u", 2, "n", "t") for row in rows]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def mixed_by_hand(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    total = defaultdict(int)
    for row, s in zip(rows, size):
        total[row[3]] += s
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, Fraction(3, 2) * sum(size), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: Fraction(2 * total[s]) for s in above}
        left -= sum(2 * total[s] for s in above)
        open_ -= above
    taken = [0] * len(rows)
    for s in names:
        mine = sorted((k for k, row in enumerate(rows) if row[3] == s), key=lambda k: (hashlib.md5(f"{'' if rows[k][0] is None else rows[k][0]}|{rows[k][1] or ''}".encode()).hexdigest()[:15], k))
        for _ in range(2):
            for k in mine:
                taken[k] += min(size[k], int(target[s]) - sum(taken[j] for j in mine))
    return Counter((row[0], n, total[row[3]], round(float(target[row[3]]), 6), t) for row, n, t in zip(rows, size, taken))


def test_mix_equals_brute_force_with_few_and_many_levels(spark, monkeypatch):
    rows = awkward_documents()
    docs = frame(spark, rows, DOCS)
    expected = mixed_by_hand(rows)
    for last, most in ((mixing.LAST, mixing.BROADCAST_SOURCES), (0, 0)):  # the second goes to the last digit and joins without a broadcast
        monkeypatch.setattr(mixing, "LAST", last)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        got = Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(docs).collect())
        assert got == expected


def test_mix_of_nothing_and_of_nothing_but_blanks(spark):
    assert mixing.mix(frame(spark, [], DOCS)).count() == 0
    blank = mixing.mix(frame(spark, [(k, " ", "en", None if k else "a", 0, "", 0, "", "") for k in range(3)], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 3


def test_mixed_texts_hold_the_taken_words(spark):
    rows = [(k, "  a\tb  c d\n" * (k % 7) + "e", "en", f"s{k % 4}", 0, "", 0, "", "") for k in range(60)]
    docs = frame(spark, rows, DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    texts = defaultdict(list)
    for r in mixing.mixed_texts(docs).collect():
        texts[r["doc_id"]].append(r["text"])
    assert {k: sum(len(t.split()) for t in v) for k, v in texts.items()} == {k: n for k, n in taken.items() if n}
    assert all(rows[k][1].startswith(t) for k, v in texts.items() for t in v)


def vectors(n=700, dim=12, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, dim)) * np.linspace(3, 0.1, dim)
    rows = [(k, (base[k % 40] + r.normal(size=dim) * 0.3).astype(np.float32).tolist(), 1 if k % 3 == 0 else int(r.integers(0, 6)), "size", 0) for k in range(n)]
    rows[100], rows[101], rows[250] = (100, rows[99][1], 1, "", 0), (101, rows[99][1], 2, "", 0), (250, None, 1, "", 0)
    odd = [(n, [float("nan")] * dim, 1), (n + 1, [1.0] * (dim - 1) + [None], 1), (n + 2, [0.0] * dim, 2), (n + 3, [1.0, 2.0], 1), (n + 4, [2.0, 1.0], 3), (n + 5, [], 1), (n + 6, rows[5][1], None), (None, rows[5][1], 1)]
    return rows + [(*o, "", 0) for o in odd] + [rows[200], (300, rows[7][1], 0, "", 0), (800, [0.5, 0.25], 1, "", 0), (900, [], 1, "", 0), (901, [], 2, "", 0)]


VECTORS = "vec_id long, embedding array<float>, label int, id string, cell int"


def mined_by_sql(rows, every):
    kept = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2] is not None, r[2] or 0)):
        kept.setdefault(r[0], r)
    table = pa.table({"vec_id": pa.array([r[0] for r in kept.values()], pa.int64()), "embedding": pa.array([r[1] for r in kept.values()], pa.list_(pa.float32())), "label": pa.array([r[2] for r in kept.values()], pa.int32())})
    con = duckdb.connect()
    con.register("embeddings", table)
    sql = corpus_sql.HARD_NEGATIVES.replace("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", "label").replace("% 100 = 0", f"% {every} = 0")
    return sorted(con.execute(sql).fetchall())


def test_hard_negatives_equal_sql_in_many_blocks(spark, monkeypatch):
    rows = vectors()
    expected = mined_by_sql(rows, 50)
    assert len(expected) > 100
    for size in ((8192, 4096, 1 << 20), (64, 4, 256)):
        for name, v in zip(("ROWS", "ANCHORS", "PAIRS"), size):
            monkeypatch.setattr(hard_negatives, name, v)
        got = hard_negatives.hard_negatives(frame(spark, rows, VECTORS), every=50).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert sorted(map(tuple, got)) == expected


def test_hard_negatives_of_nothing_and_of_huge_components(spark):
    assert hard_negatives.hard_negatives(frame(spark, [], VECTORS)).count() == 0
    rows = [(0, [1e15, 3.0], 1), (1, [1e3, 1.0], 1), (2, [9e2, 5.0], 2), (3, [1e308, 1.0], 2), (4, [-1e3, 0.0], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    product = lambda a, b: sum(int(x * 256) * int(y * 256) for x, y in zip(a, b))
    most = (1 << 63) - 1
    assert [(r["positive_id"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got if r["positive_id"] == 1 and r["negative_id"] == 2] == [(1, 2, min(most, product(rows[0][1], rows[1][1])), min(most, product(rows[0][1], rows[2][1])))]


def test_bounds_drop_no_pair_they_should_keep():
    r = np.random.default_rng(0)
    raw, q = r.normal(size=(300, 16)), r.normal(size=(20, 16))
    axes = np.linalg.qr(r.normal(size=(16, 16)))[0]
    a, b = hard_negatives._Side(raw, axes, [4, 9, 14]), hard_negatives._Side(q, axes, [4, 9, 14])
    exact = a.whole @ b.whole.T
    least, most = np.full(20, 1e5), np.full(20, 2e5)
    i, j = hard_negatives.candidates(a, b, np.arange(300), least, most, np.ones((300, 20), bool), [4, 9, 14])
    wanted = {*zip(*np.nonzero((exact >= 1e5) & (exact <= 2e5)))}
    assert wanted <= {*zip(i, j)} and len(i) < 0.5 * exact.size


def test_terms_are_counted_like_words():
    rows = awkward_documents(120)
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df = Counter(), Counter()
    for _, text, lang, source, *_ in rows:
        found = [t.translate(lower) for t in pattern.findall(text or "")]
        for t in found:
            n[lang or "", source or "", t] += 1
        for t in {*found}:
            df[lang or "", source or "", t] += 1
    columns = [pa.array([r[k] or "" for r in rows]) for k in (2, 3, 1)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])
    got_n, got_df = Counter(), Counter()
    for b in term_counts._count(iter([batch.slice(0, 50), batch.slice(50)])):
        for r in b.to_pylist():
            got_n[r["lang"], r["source"], r["term"]] += r["n"]
            got_df[r["lang"], r["source"], r["term"]] += r["df"]
    assert got_n == n and got_df == df


@pytest.mark.parametrize("sources", [256, 2])
def test_divergence_equals_sql(spark, monkeypatch, sources):
    rows = awkward_documents(600, seed=8) + [(5000, None, None, "empty", 1, "u", 2, "n", "t")]
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "POSTINGS", 200_000 if sources > 2 else 20)
    monkeypatch.setattr(divergence, "TERMS", 50 if sources > 2 else 3)
    table = pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})
    con = duckdb.connect()
    con.register("documents", table)
    expected = sorted(con.execute(corpus_sql.DIVERGENCE.replace("rank <= 50", f"rank <= {divergence.TERMS}")).fetchall())
    result = divergence.divergence(frame(spark, rows, DOCS))
    got = sorted(map(tuple, result.select("lang", "source", "part", "item", "value", "rank").collect()))
    if sources > 2:
        assert got == expected
    else:  # divergence() bound TERMS when it was defined
        assert [g for g in got if g[2] == "pair"] == [e for e in expected if e[2] == "pair"]


def test_divergence_of_nothing_and_without_kept_terms(spark):
    assert divergence.divergence(frame(spark, [], DOCS)).count() == 0
    rows = [(k, "rare word", "en", s, 0, "", 0, "", "") for k, s in enumerate(["a", "b", "b", None])]
    got = sorted(map(tuple, divergence.divergence(frame(spark, rows, DOCS)).collect()))
    assert got == [("en", a, "pair", b, 0, k + 1) for a in ["", "a", "b"] for k, b in enumerate(x for x in ["", "a", "b"] if x != a)]


def test_few_top_terms_are_the_best_ones(spark):
    r = random.Random(1)
    rows = [("en", f"s{k % 3}", f"t{k}", r.choice([1, 2, 3, 50, 900]), r.randint(0, 10**6), r.randint(0, 10**6)) for k in range(900)]
    got = divergence.top_terms(spark.createDataFrame(rows, "lang string, source string, term string, n long, p long, q long"), 4)
    expected = []
    for s in ("s0", "s1", "s2"):
        best = sorted(((q - p, t) for _, source, t, _, p, q in rows if source == s and p > q))[:4]
        expected += [("en", s, t, -v, k + 1) for k, (v, t) in enumerate(best)]
    assert sorted(map(tuple, got.select("lang", "source", "item", "value", "rank").collect())) == sorted(expected)
