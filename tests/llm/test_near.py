"""Joins and searches held against brute force, with awkward rows."""

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import ann, ngram_join, words
from lectern.llm.embedding_dedup import embedding_duplicates


def words_of(text):
    out, word = [], ""
    for c in (text or "").lower():
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def shingles_of(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def noisy_corpus(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["straße", "日本", "ÉTÉ"]
    base = [[str(x) for x in rng.choice(vocabulary, rng.integers(6, 90))] for _ in range(25)]
    texts = []
    for words_ in base:
        texts.append(" ".join(words_))
        for _ in range(rng.integers(0, 6)):
            copy = list(words_)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = "changed"
            texts.append(", ".join(copy) if rng.random() < 0.5 else " ".join(copy).upper())
    return texts + [None, "", " .,;", "one two", "One two!", "one two three", "x" * 3000, " ".join(["same"] * 5000)]


def test_shingles_count_like_sets():
    texts = noisy_corpus()
    _, offsets = words.shingles(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(shingles_of(t)) for t in texts]


def test_ngram_join_equals_brute_force(spark):
    texts = noisy_corpus()
    rows = [(k, t, "fp", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[0], (None, "no id here at all", "x", 2)], "doc_id long, text string, bands string, rep long")
    sets = [shingles_of(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components(range(len(sets)), links)
    degree = {k: sum(k in pair for pair in links) for k in range(len(sets))}
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {k: (root[k], degree[k], root[k] == k) for k in range(len(sets))}
    kept = ngram_join.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == sorted(k for k in root if root[k] == k) + [None]


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_lower_thresholds_lose_no_link(spark, threshold):
    rng = np.random.default_rng(12)
    texts, plain = {}, [f"t{k}" for k in range(5000)]
    for k in range(60):  # pairs that share a run of words, of many similarities
        run = [str(x) for x in rng.choice(plain, 60)]
        cut = int(rng.integers(0, 45))
        texts[2 * k], texts[2 * k + 1] = " ".join(run), " ".join(run[: 60 - cut] + [str(x) for x in rng.choice(plain, int(rng.integers(0, 20)))])
    sets = {i: shingles_of(t) for i, t in texts.items()}
    links = [(2 * k, 2 * k + 1) for k in range(60) if len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= threshold]
    assert 15 < len(links) < 60
    got = ngram_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), threshold=threshold).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == components(texts, links)
    assert sum(r["n_links"] for r in got) == 2 * len(links)


def test_banding_keeps_its_promise():
    assert ngram_join.banding(0.8) == (32, 5)
    for t in (0.07, 0.2, 0.5, 0.65, 0.8, 0.95):
        bands, rows = ngram_join.banding(t)
        assert bands * rows <= ngram_join.N_HASHES and (1 - t**rows) ** bands <= ngram_join.MISSED
    with pytest.raises(ValueError):
        ngram_join.banding(0.05)


def test_ngram_join_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one_of_each_group(empty).count() == 0


def test_large_blocks_count_every_link(monkeypatch):
    """Tiles and blocks give what one dense comparison gives."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.06, rng.integers(0, 1 << 62, 300).astype(np.uint64), common)) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(10)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sig = ngram_join.minhashes(np.concatenate(sets), offsets)
    found = ngram_join.links_of_tile(sig, sig, sets, sets, 0.8, ngram_join.least_matches(0.8, 1e-6), True)
    true = np.array([[i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (found == true).all() and true.any()


def test_posterior_schedule_keeps_likely_pairs():
    schedule = ngram_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in schedule] == list(range(16, 161, 16))
    assert all(m < 0.8 * n for n, m in schedule) and schedule[-1][1] > 0.5 * 160


def vectors_table(spark, seed=2, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.08 * rng.standard_normal((150, dims)), rng.standard_normal((60, dims))]).astype(np.float32)
    rows = [(int(k), [float(v) for v in row], int(k) % 3, "c") for k, row in enumerate(x)]
    rows += [(300, None, 0, "c"), (301, [0.0] * dims, 0, "c"), (302, [float("nan")] * dims, 0, "c"), (303, [None] + [1.0] * (dims - 1), 1, "c"), (304, [float("inf")] * dims, 1, "c"), (305, [], 1, "c")]
    rows += [(306, rows[0][1], 0, "c"), (307, [2 * v for v in rows[0][1]], 0, "c"), (308, rows[0][1], None, "c"), (309, rows[0][1][:4], 0, "c"), (310, rows[0][1][:4], 0, "c"), (None, rows[0][1], 0, "c"), rows[5], (350, rows[0][1], 0, "c")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")


def usable(v):
    return bool(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)


@pytest.mark.parametrize("small", [False, True])
def test_embedding_duplicates_equal_brute_force(spark, monkeypatch, small):
    from lectern.llm import embedding_dedup

    if small:  # several pivots, cells and blocks on a small table
        monkeypatch.setattr(embedding_dedup, "CELL", 8)
        monkeypatch.setattr(embedding_dedup, "LEAST_CELL", 8)
        monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    rows, df = vectors_table(spark)
    v = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None}
    ids = sorted(v)
    good = [i for i in ids if usable(v[i][0]) and v[i][1] is not None]
    links = [(a, b) for a in good for b in good if a < b and v[a][1] == v[b][1] and len(v[a][0]) == len(v[b][0]) and cosine(v[a][0], v[b][0]) >= 0.98]
    root = components(ids, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(df).collect()}
    assert got == {i: (sum(i in p for p in links), root[i], root[i] == i) for i in ids}
    assert len(links) > 100


def test_embedding_duplicates_of_an_empty_table(spark):
    assert embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_search_recall_order_ties_and_short_tables(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 32)
    monkeypatch.setattr(ann, "BLOCK", 16)
    rows, df = vectors_table(spark)
    v = {r[0]: r[1] for r in rows if r[0] is not None and usable(r[1])}
    got = {}
    for r in ann.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert sorted(got) == [q for q in sorted(v) if q % 50 == 0]
    for q, found in got.items():
        true = sorted(((-cosine(v[q], v[c]), c) for c in v if c != q and len(v[c]) == len(v[q])))[:5]
        assert [f[0] for f in found] == list(range(1, len(true) + 1))
        assert all(abs(s - cosine(v[q], v[c])) < 1e-12 for _, c, s in found)
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda x: (-x[1], x[0]))
        hits, total = hits + len({c for _, c in true} & {c for _, c, _ in found}), total + len(true)
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(few).count() == 4
    assert ann.nearest_neighbours(few.limit(0)).count() == 0


def test_small_tables_use_cells_and_parts(spark):
    from lectern.llm import embedding_dedup

    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16))
    df = spark.createDataFrame([(k, v.tolist(), k % 4) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label long")
    classes = df.selectExpr("label", "size(embedding) AS size", "vec_id AS rep", "1L AS copies", "embedding")
    assert min(len(p) for p in embedding_dedup._pivots(classes, 0.2).values()) >= 2
    router = ann.fit_router(x / np.sqrt((x * x).sum(1, keepdims=True)), 2000)
    assert router.w2.shape[1] == 16
    hits = 0
    for r in ann.nearest_neighbours(df).collect():
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        order = [c for c in np.argsort(-(u @ u[r["query_id"]])).tolist() if c != r["query_id"]][:5]
        hits += r["vec_id"] in order
    assert hits >= 0.9 * 40 * 5


def test_thinned_pivots_equal_the_plain_loop():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 3))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    from lectern.llm.embedding_dedup import thinned

    kept = []
    for v in x:
        if all(((v - p) ** 2).sum() > 0.09 for p in kept):
            kept.append(v)
    assert np.array_equal(thinned(x, 0.3), np.array(kept))


def test_the_row_kept_of_a_repeated_id_is_the_one_compared(spark):
    a, b = "one two three four five six seven eight nine ten", "a b c d e f g h i j k l m n o p"
    rows = [(1, a, "x"), (2, b, "y"), (2, a, "z"), (3, b, "w")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        kept = sorted(tuple(r) for r in ngram_join.keep_one_of_each_group(df).collect())
        classes = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(df).collect()}
        assert [r[0] for r in kept] == sorted(i for i, c in classes.items() if i == c)
        assert len({r[1] for r in kept}) == len(kept) == 2


def test_balanced_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((512, 6))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    part = ann.balanced_parts(ann.nearest(x, x, 8, np.arange(512)), 3, rng)
    assert np.bincount(part).tolist() == [64] * 8
